r"""Secrets in texts, judged by who owns the strings.

Patterns find candidates; what tells a credential from an example is the rest
of the corpus. The hash of every candidate is counted over the whole corpus by
distinct repositories and distinct owners: a string that many owners hold has
been copied from a manual, one that is only its owner's and looks drawn at random is taken
for live.

Everything is a DataFrame or SQL function. A text is read once: the matches of
a pattern and the gaps between them (``split`` by the same pattern) give lengths
and hashes, which go on without the text; places are their running sums. Counts
go through distinct (hash, repository) and (hash, owner) pairs, so a string that
is everywhere is added up where it lies before it is shuffled, and verdicts come back by
``hot_lookup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import hot_lookup, store

# Kinds in the order in which spans of one start are listed, pattern, and the
# group that is the secret itself. The first three are the base, of which every span counts.
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
KINDS = [
    ("assign", r"""(""" + _WORDS + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("bearer", r"[Bb][Ee][Aa][Rr][Ee][Rr]\x20+([A-Za-z0-9._~+/=-]{16,})", 1),
    ("key", r"[A-Za-z0-9_+-]{20,}", 0),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\x20\x0A\x0D]{16,})", 1),
    ("url", r"://[^\x00-\x20/:@]{1,64}:([^\x00-\x20/@]{4,128})@", 1),
]
BASE = ("assign", "access", "hex")
PLACEHOLDERS = r"example|changeme|placeholder|dummy|sample|your|xxxx|\*\*\*|1234567|abcdefg"
LEAST_ASSIGNED, LEAST_VARIETY = 6, 8


def looks_live(kind: str, value: Column) -> Column:
    """No placeholder, and as many different characters as a drawn string has; a bare run
    of ``key`` also needs both cases and three digits, which words and names lack."""
    variety = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))))
    live = (variety >= LEAST_VARIETY) & ~F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").rlike(PLACEHOLDERS)
    if kind == "key":
        live = live & value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9][^0-9]*[0-9][^0-9]*[0-9]")
    return live


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """(gap before, length, hash, whether it counts, whether it looks live) of each match, in order."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    # zipped, so that each of the three is made once a text and not once a match; the last gap follows no match
    found = [gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole")]
    if group:
        found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("said"))

    def one(m: Column) -> Column:
        value = m["said" if group else "whole"]
        counts = F.length(value) >= LEAST_ASSIGNED if kind == "assign" else F.lit(True)
        return F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("len"), F.sha2(value.cast("binary"), 256).alias("hash"),
                        counts.alias("counts"), looks_live(kind, value).alias("live"))
    matches = F.transform(F.filter(F.arrays_zip(*found), lambda m: m["whole"].isNotNull()), one)
    none = F.array().cast("array<struct<gap:int,len:int,hash:string,counts:boolean,live:boolean>>")
    return F.when(text.rlike(pattern), matches).otherwise(none)


def read_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id",
               owner_col: str = "source") -> DataFrame:
    """A stored row a document: ``row`` (its number here), ``id``, repository, owner, and the matches of each kind.

    Null texts are empty; null repositories and owners count as one unknown each.
    Other columns are not read."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"),
                      F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return store(own.select(F.monotonically_increasing_id().alias("row"), "id", "repository", "owner",
                            *[_matches(F.col("t"), kind, p, g).alias(kind) for kind, p, g in KINDS]), "secrets-read")


def spans_of(read: DataFrame) -> DataFrame:
    """A row a match: row, repository, owner, place (of its kind in KINDS), kind, start, end (code points, exclusive), hash, live."""
    parts = [read.select("row", "repository", "owner", F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("nth", "m"))
             for i, (kind, _, _) in enumerate(KINDS)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    so_far = Window.partitionBy("row", "place").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(so_far))
    return rows.where("m.counts").select("row", "repository", "owner", "place", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end",
                                         F.col("m.hash").alias("hash"), F.col("m.live").alias("live"))


def ownership(spans: DataFrame) -> DataFrame:
    """A row a hash: occurrences, repositories and owners that hold it, counted over all spans."""
    pairs = spans.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    held = pairs.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("repositories"))
    owned = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    return held.join(owned, "hash")


def find_secrets(read: DataFrame, owners: int = 3, repositories: int = 20) -> DataFrame:
    """The spans of ``read_texts``, each with ``occurrences``, ``repositories``, ``owners`` and a ``verdict``.

    ``example``: held by ``owners`` owners or more, or by two or more in at least
    ``repositories`` repositories. ``live``: any other that looks drawn at random.
    ``weak``: the rest. All spans of the base kinds are returned; those of the other
    kinds where they are live and overlap no span of the base."""
    spans = store(spans_of(read), "secrets-spans")
    facts = store(ownership(spans), "secrets-owners")
    total = facts.agg(F.sum("occurrences")).first()[0] or 0
    known = hot_lookup(spans, facts, "hash", "occurrences", total)
    copied = (F.col("owners") >= owners) | ((F.col("owners") > 1) & (F.col("repositories") >= repositories))
    known = known.withColumn("verdict", F.when(copied, "example").when(F.col("live"), "live").otherwise("weak"))
    base = F.col("kind").isin(*BASE)
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    # the other way round, not up to unboundedFollowing, which is quadratic in a document's spans
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    known = known.where(base | (F.col("verdict") == "live")) \
        .withColumn("_ends", F.max(F.when(base, F.col("end"))).over(before)).withColumn("_starts", F.min(F.when(base, F.col("start"))).over(after))
    free = (F.coalesce("_ends", F.lit(-1)) <= F.col("start")) & F.coalesce(F.col("_starts") >= F.col("end"), F.lit(True))
    return known.where(base | free).select("row", "place", "kind", "start", "end", "hash", "occurrences", "repositories", "owners", "verdict")


def listed(places: Column) -> Column:
    """``kind:start:end`` of an array of (start, place, end, kind), by start and kind, comma-joined."""
    return F.concat_ws(",", F.transform(F.sort_array(places), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_document(read: DataFrame, spans: DataFrame) -> DataFrame:
    """A row a document, those without a span too: ``id``, counts of the base kinds, ``base`` and ``spans`` listed, counts of verdicts."""
    at = F.struct("start", "place", "end", "kind")
    base = F.col("kind").isin(*BASE)
    rows = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        listed(F.collect_list(F.when(base, at))).alias("base"), listed(F.collect_list(at)).alias("spans"),
        F.count(F.when(F.col("verdict") == "live", 1)).alias("n_live"), F.count(F.when(F.col("verdict") == "example", 1)).alias("n_examples"))
    zero = {f"n_{k}": 0 for k in BASE} | {"base": "", "spans": "", "n_live": 0, "n_examples": 0}
    return read.select("row", "id").join(rows, "row", "left").fillna(zero, list(zero)).drop("row")
