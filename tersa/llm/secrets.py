"""Secret scan with corpus-wide ownership: who else holds the same value tells an example from a live credential.

Patterns find candidates in every text, with their places. All values are hashed and counted over the whole corpus by
distinct repositories and owners. A value that many owners hold is a copied example; one that few owners hold and
that looks generated (letters and digits, many different characters, no placeholder) is owned. Base matches are always
reported; the method adds spans of owned values that no base pattern describes: token-like words, also where
the value stands bare in one text and behind a keyword in another. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tersa.llm.common import Scratch, with_row

# fixed values: the base patterns of the contract, in the order in which ties of a start are listed
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Words that may be a credential of any other form, and how long they may be.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN_MOST = 200
#: Different characters that a generated value of any length has at least.
DIFFERENT = 8
#: A value that so many owners or more hold is a copied example.
COPIED_OWNERS = 3
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|your[_-]|dummy|xxxx|0123456789|abcdefgh"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = (ASSIGN, ACCESS, HEX, TOKEN)
#: Values that hold more than one in so many of all candidates are joined by broadcast; there can be no more of them than that.
HOT = 1000


def _matches(text: Column, pattern: str) -> Column:
    """(gap, match) of each match: the characters between it and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))


def all_matches(text: Column) -> Column:
    """(kind, at, gap, match) of each match of each pattern."""
    text = F.coalesce(text, F.lit(""))

    def tagged(kind: int, pattern: str) -> Column:
        return F.transform(
            _matches(text, pattern),
            lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["match"].alias("match")),
        )

    return F.concat(*[tagged(kind, pattern) for kind, pattern in enumerate(PATTERNS)])


def candidates(scanned: DataFrame) -> DataFrame:
    """A row for each match that counts: _row, repository, owner, kind (its number), start, stop, value.

    Positions are code points; a running sum over a text's gaps and matches gives them.
    """
    rows = scanned.select("_row", "repository", "owner", F.explode("matches").alias("m")).select("_row", "repository", "owner", "m.*")
    upto = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(upto)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    placed = rows.withColumn("stop", stop).withColumn("value", value)
    placed = placed.where((F.col("kind") != 0) | (F.length("value") >= ASSIGN_LEAST))
    return placed.select(
        "_row", "repository", "owner", "kind", (F.col("stop") - F.length("match")).cast("long").alias("start"),
        F.col("stop").cast("long").alias("stop"), "value",
    )


def looks_generated(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (F.length(value) <= TOKEN_MOST)
        & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n, n_repositories, n_owners) of every value of the corpus; combined before each shuffle, so no value is hot."""
    places = found.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    repositories = places.groupBy("hash", "repository").agg(F.sum("n").alias("n"), F.collect_set("owner").alias("owners"))
    owners = places.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    counted = repositories.groupBy("hash").agg(F.sum("n").alias("n"), F.count("repository").alias("n_repositories"))
    return counted.join(owners, "hash")


def scan_secrets(
    docs: DataFrame, scratch: Scratch, repository: str | Column = "source", owner: str | Column | None = None,
    copied_owners: int = COPIED_OWNERS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Secrets in every text of ``docs``: (documents, spans, values).

    ``repository`` names where a document comes from; ``owner`` is by default its part before the last slash, so
    that ``alice/site`` and ``alice/app`` have one owner and a plain name is its own. A document without one (null)
    counts as one unnamed place, together with all others of its sort.

    documents has the columns of ``docs`` but the text (under ``doc``), n_assign, n_access, n_hex, base and spans (arrays of
    kind:start:end, by start, then kind), n_owned and n_copied. spans has a row for each span: _row, kind, start, stop,
    hash, verdict. values has hash, n, n_repositories, n_owners and verdict (``copied``: so many owners or more; ``plain``: does
    not look generated; else ``owned``). Base matches stay whatever their verdict. A word of TOKEN form becomes a span of
    kind ``owned`` if its value is owned and no base span overlaps it.

    Null text is empty; an empty table gives empty tables; repeated rows are documents of their own; other columns are
    kept as they are, whatever their names. A very long text must fit a task; its matches are rows.
    """
    where = F.col(repository) if isinstance(repository, str) else repository
    whose = (F.col(owner) if isinstance(owner, str) else owner) if owner is not None else F.regexp_replace(where, "/[^/]*$", "")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    scanned = docs.select(
        F.struct(*kept).alias("doc"), F.coalesce(where.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(whose.cast("string"), F.lit("")).alias("owner"), all_matches(F.col("text")).alias("matches"),
    )
    scanned = scratch.keep(with_row(scanned), "scanned")  # without the texts
    found = candidates(scanned)
    found = found.withColumn("hash", F.sha2("value", 256)).withColumn("generated", looks_generated("value")).drop("value")
    found = scratch.keep(found, "candidates")
    return _judged(scanned, found, scratch, copied_owners)


def _judged(scanned: DataFrame, found: DataFrame, scratch: Scratch, copied_owners: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    generated = found.groupBy("hash").agg(F.max("generated").alias("generated"))
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("generated"), "owned").otherwise("plain")
    values = scratch.keep(ownership(found).join(generated, "hash").withColumn("verdict", verdict).drop("generated"), "values")
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(values.where(F.col("n") * HOT > total).select("hash", F.col("verdict").alias("_hot")))  # below HOT rows
    mixed = found.join(hot, "hash", "left")
    cold = mixed.where("_hot IS NULL").drop("_hot").join(values.select("hash", "verdict"), "hash")
    spans = mixed.where("_hot IS NOT NULL").withColumnRenamed("_hot", "verdict").unionByName(cold)
    # a span of the method must not overlap a base span: starts and stops in one order, base first
    base_stop = F.max(F.when(F.col("kind") < 3, F.col("stop"))).over(
        Window.partitionBy("_row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    )
    base_start = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(
        Window.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = spans.withColumn("_before", base_stop).withColumn("_after", base_start)
    clear = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("stop")) >= F.col("stop"))
    spans = spans.where((F.col("kind") < 3) | ((F.col("verdict") == "owned") & clear))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = scratch.keep(spans.select("_row", name.alias("kind"), F.col("kind").alias("_kind"), "start", "stop", "hash", "verdict"), "spans")
    place = F.struct("start", "_kind", F.concat_ws(":", "kind", "start", "stop").alias("name"))

    def names(of: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(of)), lambda x: x["name"])

    by_row = spans.groupBy("_row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(F.col("verdict") == "copied", 1)).alias("n_copied"),
        names(F.when(F.col("_kind") < 3, place)).alias("base"), names(place).alias("spans"),
    )
    none = F.array().cast("array<string>")
    counts = [f"n_{k}" for k in KINDS] + ["n_copied"]
    documents = scanned.select("_row", "doc").join(by_row, "_row", "left").select(
        "doc", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, none).alias(c) for c in ("base", "spans")]
    )
    return documents, spans.drop("_kind"), values
