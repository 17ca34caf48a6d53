"""Secret scan with corpus-wide ownership frequency (DataFrame operations only).

Base spans, leftmost and non-overlapping per kind: ``assign`` (a named value),
``access`` (an access key id), ``hex`` (a long run of hex digits). The method
adds ``owned`` spans: random-looking tokens without such a context.

A candidate value is the assigned value, the key id, the hex run or the token.
Its hash is aggregated over the corpus by distinct repositories and owners: a
value that many owners publish is a copied example, a value that stays with few
owners in few repositories looks like a live credential. Tokens become spans
only if they look live; base spans always stay, and each carries the verdict.

Where the tables name no owner, ``source`` is taken as the owner and
(``source``, ``lang``) as the repository; both are parameters.

Positions: ``split`` at a pattern gives the texts between its matches, and
``regexp_extract_all`` the matches, by the same engine in the same order, so
running sums of their lengths are the starts in code points.

The hash table is aggregated in two steps (distinct hash, owner and repository,
then counts), each with a partial aggregate, so a value in a third of all rows
costs one row per task. Verdicts join back on the hash with one row per hash.
Only candidates are shuffled, never texts.

Defined results: null text counts as empty; null owners or repositories count
as one owner or repository of their own; repeated rows and doc_ids keep one row
each (repeated rows have one owner); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, read, whole_text

#: Kind -> (pattern, group of the value). Spans are whole matches.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    "access": (r"AKIA[A-Z0-9]{16,}", 0),  # as AKIA[A-Z0-9]+ of 20 or more: a later start in a run is shorter still
    "hex": (r"[0-9a-f]{24,}", 0),  # the runs [0-9a-f]+ of 24 or more
    "owned": (r"[A-Za-z0-9_-]{24,}", 0),
}
KINDS = list(PATTERNS)
MIN_VALUE = 6
#: A value is live-looking with at most so many distinct owners and repositories.
MAX_OWNERS, MAX_REPOSITORIES = 1, 2
#: A token looks random with a digit, an upper and a lower case letter, and so many different characters.
MIN_DISTINCT = 12


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, stop, kind, value>> of the matches of one kind."""
    pattern, group = PATTERNS[kind]
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    values = F.regexp_extract_all(text, pat, F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,kind:int,value:string>>").alias("found"))

    def step(state, i):
        start = state["at"] + F.length(F.get(gaps, i))
        stop = start + F.length(F.get(whole, i))
        one = F.struct(start.alias("start"), stop.alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), F.get(values, i).alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), F.size(whole) - 1), empty, step, lambda s: s["found"])
    return F.when(F.size(whole) > 0, found).otherwise(empty["found"])


def _random_looking(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (different >= MIN_DISTINCT)


def _random_looking(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (different >= MIN_DISTINCT)


def candidates(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``text`` -> ``found`` instead: array<struct<start,
    kind, stop, hash>> of the base spans and of the random-looking tokens that
    touch none of them, by start, then kind."""
    text = F.col("text")
    base = F.concat(F.filter(matches(text, "assign"), lambda m: F.length(m["value"]) >= MIN_VALUE), matches(text, "access"), matches(text, "hex"))
    tokens = F.filter(matches(text, "owned"), lambda m: _random_looking(m["value"]))
    free = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    hashed = F.transform(F.concat("base", free), lambda m: F.struct(m["start"], m["kind"], m["stop"], F.sha2(m["value"], 256).alias("hash")))
    return rows.withColumn("base", base).withColumn("tokens", tokens).withColumn("found", F.array_sort(hashed)).drop("base", "tokens", "text")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owner, repository) rows -> (hash, n_owners, n_repositories, live)."""
    counts = found.distinct().groupBy("hash").agg(
        F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct(F.struct("repository")).alias("n_repositories")
    )
    return counts.withColumn("live", (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES))


def scan(docs: DataFrame, owner: list[str], repository: list[str]) -> DataFrame:
    """(row, doc_id, text_hash, owner, repository, found): the candidates of
    each document, written once; row numbers the rows."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(*[F.col(f"`{c}`").cast("string").alias(f"o{i}") for i, c in enumerate(owner)]).alias("owner"),
        F.struct(*[F.col(f"`{c}`").cast("string").alias(f"r{i}") for i, c in enumerate(repository)]).alias("repository"),
        whole_text().alias("text"),
    )
    return materialize(candidates(rows.withColumn("text_hash", F.xxhash64("text"))), "secret-scan")


def verdicts(rows: DataFrame) -> DataFrame:
    """(row, start, kind, stop, n_owners, n_repositories, live): one row per
    span: all base spans and the tokens that look live."""
    each = rows.where(F.size("found") > 0).select("row", "owner", "repository", F.explode("found").alias("f"))
    known = ownership(each.select(F.col("f.hash").alias("hash"), "owner", "repository"))
    told = each.select("row", "f.*").join(known, "hash").drop("hash")
    return told.where((F.col("kind") != KINDS.index("owned")) | F.col("live"))


def secrets(docs: DataFrame, owner: list[str], repository: list[str]) -> DataFrame:
    """(doc_id, spans): one row per document; spans: array<struct<start, kind,
    stop, n_owners, n_repositories, live>> by start, then kind (the position in
    ``KINDS``)."""
    rows = scan(docs, owner, repository)
    spans = verdicts(rows).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "n_owners", "n_repositories", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, owner: list[str], repository: list[str], mark: str = "[SECRET]", length: str = "n_chars") -> DataFrame:
    """The documents with every live-looking span replaced by ``mark`` (and the
    column ``length``, where there is one, brought up to date); copied examples
    stay. Documents without live spans come back as they are and are never
    shuffled unless they hold a candidate. A null text stays null."""
    rows = scan(docs, owner, repository)
    live = verdicts(rows).where("live").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    # equal texts have equal spans, so repeated rows need one entry
    cuts = rows.select("row", "doc_id", "text_hash").join(live, "row").groupBy("doc_id", "text_hash").agg(F.first("cut").alias("cut"))

    columns, inner = docs.columns, free_name(docs, "cut_here")
    text = whole_text()
    holds = F.lit(False)
    for kind, (pattern, _) in PATTERNS.items():
        holds = holds | text.rlike(pattern)
    to, state = F.col(inner), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, c):
        fresh = c["start"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, c["start"] - s["at"]), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], c["stop"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    new = F.when(to.isNull(), F.col("text")).otherwise(F.aggregate(to, state, step, rest))
    own = docs.where(holds)
    at = own["doc_id"].cast("long").eqNullSafe(cuts["doc_id"]) & (F.xxhash64(F.coalesce(own["text"].cast("string"), F.lit(""))) == cuts["text_hash"])
    joined = own.join(cuts.select(F.col("doc_id"), "text_hash", "cut"), at, "left").select(*[own[f"`{c}`"] for c in columns], cuts["cut"].alias(inner))
    changed = joined.withColumn("text", new)
    if length in columns:
        changed = changed.withColumn(length, F.when(to.isNull(), F.col(length)).otherwise(F.length("text")).cast(docs.schema[length].dataType))
    return docs.where(~holds).unionByName(changed.select(*[F.col(f"`{c}`") for c in columns]))


def listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


OWNER, REPOSITORY = ["source"], ["source", "lang"]


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secrets(read(spark, sf_dir, "documents"), OWNER, REPOSITORY)
    base = F.filter("spans", lambda s: s["kind"] != KINDS.index("owned"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        n("owned").alias("n_owned"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
