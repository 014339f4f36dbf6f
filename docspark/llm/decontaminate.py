"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes a list of lower-case words in which numbers, units (after a
number) and names (a capitalised word inside a sentence) are slots: in the
template each is only its type, and its value is kept beside it. Every run of
``window`` template words of every document is hashed and joined with the runs
of the benchmark items. Runs with the item's own values are verbatim and count.
Those with other values that lie on one alignment of a document with an item
count if their slots are consistent: wherever the item repeats a value, the
document repeats one too. So an item whose numbers, names or units were
exchanged is found, and chance matches that mix values are not.

The documents are read once and never shuffled as text; only matches are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small_side, store

# Unit words that make a slot after a number.
UNITS = ("km m cm mm kg g mg lb lbs oz mi mile miles ft feet inch inches l ml litre litres liter liters h hour hours "
         "min minute minutes s sec second seconds day days week weeks month months year years percent dollar dollars "
         "euro euros cent cents pound pounds").split()

#: Marks of a slot's type, private-use characters: number, name, unit; and the joint inside a number.
NUMBER, NAME, UNIT, JOINT = "\ue001", "\ue002", "\ue003", "\ue004"
_SLOT = f"[{NUMBER}-{UNIT}]"


def _lowered(text: Column) -> Column:
    """Lower case, with a mark before each capitalised word inside a sentence; null is empty."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{NUMBER}-{JOINT}]+", " ")
    return F.lower(F.regexp_replace(t, r"(?<=[\p{L}\p{N},;]) (?=\p{Lu}\p{Ll})", f" {NAME}"))


def _numbered(low: Column) -> Column:
    """Numbers and the units that follow them, marked."""
    t = F.regexp_replace(low, "(?<=[0-9])[.,:/](?=[0-9])", JOINT)
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    t = F.regexp_replace(t, rf"(?<![\p{{L}}0-9{JOINT}])([0-9][0-9{JOINT}]*)(?![0-9{JOINT}])(?: ?((?:{units})(?![\p{{L}}0-9])|%))?",
                         f" {NUMBER}$1 {UNIT}$2 ")
    return F.regexp_replace(t, rf"{UNIT} ", " ")  # no unit followed


def _line(t: Column) -> Column:
    """Words parted by single spaces, without punctuation."""
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}0-9" + f"{NUMBER}-{JOINT}]+", " "))


def readings(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, reading, line, marked): each ``text`` as a line of marked words, and a second
    time with its names as plain words if it has any: a copy in other case then still meets
    its item. Steps are columns of their own, so that none is computed twice."""
    # posexplode_outer, since an inner one would infer a filter that repeats the work
    return (rows.withColumn("low", _lowered(F.col("text")))
            .withColumn("low", F.when(F.contains("low", F.lit(NAME)), F.array("low", F.replace("low", F.lit(NAME), F.lit(""))))
                        .otherwise(F.array("low")))
            .select(*keep, F.posexplode_outer("low").alias("reading", "low"))
            .withColumn("low", F.when(F.col("low").rlike("[0-9]"), _numbered(F.col("low"))).otherwise(F.col("low")))
            .withColumn("line", _line(F.col("low"))).drop("low").where("line <> ''")
            .withColumn("marked", F.contains("line", F.lit(NUMBER)) | F.contains("line", F.lit(NAME))))


def _spoken(text: Column) -> Column:
    """Whether a text has any word beside numbers and units."""
    return _line(_numbered(F.replace(_lowered(text), F.lit(NAME), F.lit("")))).rlike(f"(^| )[^ {NUMBER}-{UNIT}]")


def template(line: Column) -> Column:
    """The words of a line, each slot only its type."""
    return F.split(F.regexp_replace(line, f"({_SLOT})[^ ]*", "$1"), " ")


def _hashes(words: Column, length: int) -> Column:
    """A hash of each run of ``length`` words from the words' hashes."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - (length - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, length)]) if length > 1 else w)


def _runs(words: Column, hashes: Column, values: Column, length: int) -> Column:
    """Array of (pos, length, h, slots): the runs with the values of their slots, space-joined."""
    def slots(i: Column) -> Column:
        run = F.array(*[F.get(values, i + k) for k in range(length)])
        return F.array_join(F.filter(run, lambda v: v.rlike(f"^{_SLOT}")), " ")

    return F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), F.lit(length).alias("length"), h.alias("h"),
                                                     F.when(values.isNotNull(), slots(i)).otherwise("").alias("slots")))


def _own(h: Column, length: Column, slots: Column) -> Column:
    """The hash of a run; of one of which under half the words are plain, with its values."""
    slotted = F.length(slots) - F.length(F.replace(slots, F.lit(" "), F.lit(""))) + 1
    return F.when((slots != "") & (slotted * 2 > length), F.xxhash64(h, slots)).otherwise(h)


def _windows(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """``rows`` with a ``text``: (keep, reading, words, pos, length, h, slots), a row for each run of each length."""
    rows = readings(rows, keep).select(
        *keep, "reading", "marked",
        F.transform(F.when(F.col("marked"), template(F.col("line"))).otherwise(F.split("line", " ")), lambda w: F.xxhash64(w)).alias("words"),
        F.when(F.col("marked"), F.split("line", " ")).alias("values"))
    for n in lengths:
        rows = rows.withColumn(f"h{n}", _hashes(F.col("words"), n))
    runs = [_runs(F.col("words"), F.col(f"h{n}"), F.col("values"), n) for n in lengths]
    # A text has one of two arrays, plain hashes if it has no slots (and one length is asked for),
    # else structs; the arrays must not be carried along with each run.
    plain = ~F.col("marked") & F.lit(len(lengths) == 1)
    rows = rows.select(*keep, "reading", F.size("words").alias("words"), F.when(plain, F.col(f"h{lengths[-1]}")).alias("plain"),
                       F.when(~plain, F.concat(*runs)).alias("runs"))
    rows = rows.select(*keep, "reading", "words", "runs", F.posexplode_outer("plain").alias("at", "plain"))
    rows = rows.select(*keep, "reading", "words", "at", "plain", F.explode_outer("runs").alias("run"))
    return rows.where("plain is not null or run is not null").select(
        *keep, "reading", "words", F.coalesce("at", "run.pos").alias("pos"),
        F.coalesce("run.length", F.lit(lengths[-1])).alias("length"), F.coalesce("plain", "run.h").alias("h"),
        F.coalesce("run.slots", F.lit("")).alias("slots")).withColumn("h", _own(F.col("h"), F.col("length"), F.col("slots")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = 8, overlap: int = 13,
                       least: int = 5, broadcast_rows: int = 500_000) -> DataFrame:
    """One row a document and item: ``id_col``, text_hash, ``item_col``, item_words, covered_words, changed_slots.

    A document is contaminated by an item if runs of ``window`` words, verbatim or
    with changed values that are consistent on their alignment, cover at least
    ``overlap`` of the item's words, or all of a shorter item; an item shorter
    than a window is searched as a whole.
    ``changed_slots``: some slot has another value than the item's (the
    question was re-parameterised). A run of which under half the words are
    plain counts only with the item's own values. An item under ``least`` words
    carries no evidence, nor one of numbers and units alone; null and
    empty texts never match. Repeated rows count as one document; rows that
    share an id with other texts are told apart by text_hash; a null id stays
    null. Benchmark rows that repeat are one item. Other columns are not read.

    The benchmark's runs are broadcast when a count says they are at most
    ``broadcast_rows`` (some 60 bytes each), else the join shuffles.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    short = [r[0] for r in readings(items, ["item"]).select(F.size(template(F.col("line"))).alias("n")).where(F.col("n").between(least, window - 1)).distinct()
             .orderBy("n").collect()]  # at most window - least numbers
    # readings with and without names have equal words, so one text has one length
    known = _windows(items.where(_spoken(F.col("text"))), [*short, window], ["item"])
    known = (known.where((F.col("length") == F.least("words", F.lit(window))) & (F.col("words") >= least))
             .select("h", "item", F.col("reading").alias("item_reading"), F.col("words").alias("item_words"),
                     F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "length"))
    known = store(known, "benchmark-runs")
    known = small_side(known, broadcast_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                       F.col(text_col).alias("text"))
    found = _windows(rows, [*short, window], ["id", "text_hash"]).drop("words").join(known, ["h", "length"])
    run, same = F.sequence("item_pos", F.col("item_pos") + F.col("length") - 1), F.col("slots") == F.col("item_slots")
    pairs = F.arrays_zip(F.split("item_slots", " ").alias("of"), F.split("slots", " ").alias("to"))
    one = (found.groupBy("id", "text_hash", "item", "reading", "item_reading", "item_words",
                         (F.col("pos") - F.col("item_pos")).alias("shift"))
           .agg(F.collect_set(F.when(same, run)).alias("same"), F.collect_set(F.when(~same, run)).alias("other"),
                F.collect_set(F.when(~same, pairs)).alias("pairs")))
    one = one.withColumn("pairs", F.array_distinct(F.flatten("pairs")))
    consistent = F.size(F.array_distinct("pairs.of")) == F.size("pairs")
    covered = F.array_distinct(F.flatten(F.flatten(F.collect_list("at"))))
    return (one.withColumn("at", F.when(consistent, F.concat("same", "other")).otherwise(F.col("same"))).where("size(at) > 0")
            .withColumn("changed", F.size("other") > 0)
            .groupBy("id", "text_hash", "item", "item_words")
            .agg(F.size(covered).alias("covered_words"), F.min("changed").alias("changed_slots"))
            .where(F.col("covered_words") >= F.least(F.lit(overlap), "item_words"))
            .select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), "item_words",
                    "covered_words", "changed_slots"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """``docs``, all columns and rows, without the contaminated documents."""
    name = "hit"
    while name in docs.columns:
        name += "_"
    found = find_contamination(docs, benchmark, id_col, text_col, **options)
    found = store(found.select(F.struct(F.col(id_col).alias("id"), "text_hash").alias(name)).distinct(), "contaminated")
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return docs.withColumn(name, own).join(small_side(found), name, "left_anti").drop(name)
