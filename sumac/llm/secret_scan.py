"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong finds (``assign``, ``access``, ``hex``) are reported wherever they stand. Weak parts are short assigned secrets
(``weak_assign``), shorter hex runs (``weak_hex``), assigned user or client names (``ident``) and endpoints
(``endpoint``). They are reported only when complementary parts co-occur: within SCOPE code points of the part's start
there must be an identifier (access or ident) and a secret (assign, hex, weak_assign or weak_hex), of which the part
itself may be one. The parts of texts that have both roles become rows, and semi joins over intervals, keyed by text
and scope-wide bin, keep those that link. The joins are keyed by the text's digest, so that copies of a text are linked
once and a hot document id makes no hot key; a bin holds at most SCOPE / 3 parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.llm.text import field, free, sheltered, stored

#: Code points within which complementary parts count as co-occurring.
SCOPE = 200
#: The patterns of the strong kinds and the least length of what they take.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs under 16 characters never count, and hold no later start that would
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_HEX = 8, 32
IDENT = r"""(?i)(?:user(?:_?name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"""(?:[a-z][a-z0-9+]*://[^\x20\x09-\x0D"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b)"""
#: In the order that breaks ties of start.
KINDS = ["assign", "access", "hex", "ident", "weak_assign", "weak_hex", "endpoint"]
IDENTIFIERS, SECRETS = ["access", "ident"], ["assign", "hex", "weak_assign", "weak_hex"]
#: The columns of scan().
NEW = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")
_SPAN = "array<struct<s:int,k:int,e:int>>"
#: Numbers that are added up at once.
_CHUNK = 256


def _let(value: Column, make) -> Column:
    """make(value) with the value computed once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _before(values: Column, join) -> Column:
    """Of each number of an array (0 or more) what those before it come to; in chunks, so that no long array is copied for each of its numbers."""

    def along(numbers: Column, get) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(numbers, start, lambda a, x: F.struct(join(a["at"], get(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    last = F.greatest(F.lit(0), F.ceil(F.size(values) / _CHUNK).cast("int") - 1)
    chunks = F.transform(F.sequence(F.lit(0), last), lambda k: along(F.slice(values, k * _CHUNK + 1, F.lit(_CHUNK)), lambda x: x))
    return _let(chunks, lambda c: F.flatten(F.zip_with(c, along(c, lambda x: x["at"])["out"], lambda x, b: F.transform(x["out"], lambda y: join(b, y)))))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The spans {s, e, n} of a pattern, in code points: lengths of the gaps between matches and of the matches, summed up; n is the length of the given group."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    matched = F.transform(found, F.length)
    taken = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else matched
    each = F.filter(F.arrays_zip(matched.alias("m"), F.transform(gaps, F.length).alias("g"), taken.alias("n")), lambda x: x["m"].isNotNull())
    span = lambda x, b: F.struct((b + x["g"]).alias("s"), (b + x["g"] + x["m"]).alias("e"), x["n"].alias("n"))
    spans = _let(each, lambda z: F.zip_with(z, _before(F.transform(z, lambda x: x["g"] + x["m"]), lambda p, q: p + q), span))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<s:int,e:int,n:int>>"))


def _as(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"))).cast(_SPAN)


def _of(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda x: x["k"].isin([KINDS.index(k) for k in kinds]))


def _said(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_sha256, spans (string) and found (the spans as an array of structs
    {s, k, e}: start, number of the kind in KINDS, end exclusive).

    A null or empty text has no spans. Repeated rows stay repeated and get the same answer. A column of docs that has the
    name of a new one is replaced; ``keep`` names those that go along (default: all).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in NEW]
    whole = F.coalesce(field(docs, text).cast("string"), F.lit(""))
    first = docs.select(F.struct(*[field(docs, c) for c in keep]).alias("row"), whole.alias("text"))
    first = first.withColumns({"a": _matches(F.col("text"), ASSIGN, group=2), "x": _matches(F.col("text"), HEX), "i": _matches(F.col("text"), ACCESS)})
    strong = F.concat(
        _as(F.filter("a", lambda v: v["n"] >= LEAST_ASSIGN), "assign"), _as(F.col("i"), "access"), _as(F.filter("x", lambda v: v["e"] - v["s"] >= LEAST_HEX), "hex")
    )
    weak = F.concat(_as(F.filter("a", lambda v: v["n"] < LEAST_ASSIGN), "weak_assign"), _as(F.filter("x", lambda v: v["e"] - v["s"] < LEAST_HEX), "weak_hex"))
    secret = (F.size("a") > 0) | (F.size("x") > 0)
    none = F.array().cast("array<struct<s:int,e:int,n:int>>")
    second = first.select("row", "text", strong.alias("strong"), weak.alias("weak"), F.when(secret, _matches(F.col("text"), IDENT)).otherwise(none).alias("d"))
    both = (F.size(_of(F.col("strong"), SECRETS)) + F.size("weak") > 0) & (F.size(_of(F.col("strong"), IDENTIFIERS)) + F.size("d") > 0)
    third = second.select("row", "text", "strong", "weak", "d", F.when(both, _matches(F.col("text"), ENDPOINT)).otherwise(none).alias("u"), both.alias("both"))
    rest = F.concat(_as(F.col("d"), "ident"), F.col("weak"), _as(F.col("u"), "endpoint"))
    rest = F.when(F.col("both"), rest).otherwise(F.array().cast(_SPAN))
    scanned = stored(third.select("row", "strong", rest.alias("rest"), F.when(F.col("both"), F.sha2(F.col("text"), 256)).alias("key")))

    linked = _linked(scanned.where("key is not null and size(rest) > 0").select("key", "strong", "rest").dropDuplicates(["key"]))
    linked = linked.groupBy("key").agg(F.collect_set("part").alias("more"))
    # rows without weak parts keep out of the join: their null keys would meet in one task
    parted = scanned.where("key is not null").join(linked.withColumnRenamed("key", "link"), F.col("key") == F.col("link"), "left").drop("link")
    out = parted.unionByName(scanned.where("key is null"), allowMissingColumns=True)
    found = F.concat("strong", F.coalesce("more", F.array().cast(_SPAN)))
    counted = [F.size(_of(F.col("strong"), [k])).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep],
        *counted, F.sha2(_said(F.col("strong")), 256).alias("base_sha256"), _said(found).alias("spans"), F.array_sort(found).alias("found"),
    )


def _linked(texts: DataFrame) -> DataFrame:
    """(key, part) of the weak parts that have both roles within SCOPE: an interval semi join for each role."""
    parts = texts.select("key", F.explode(F.concat("strong", "rest")).alias("part")).withColumn("at", F.col("part.s"))
    number = {k: n for n, k in enumerate(KINDS)}
    weak = parts.where(F.col("part.k") > number["hex"]).withColumn("bin", F.floor(F.col("at") / SCOPE))
    for role in (IDENTIFIERS, SECRETS):
        other = parts.where(F.col("part.k").isin([number[k] for k in role])).select("key", F.col("at").alias("there"))
        other = other.withColumn("near", F.explode(F.array(*[F.floor(F.col("there") / SCOPE) + d for d in (-1, 0, 1)])))
        near = reduce(lambda a, b: a & b, [weak["key"] == other["key"], weak["bin"] == other["near"], F.abs(weak["at"] - other["there"]) <= SCOPE])
        weak = weak.join(other, near, "left_semi")
    return weak.select("key", "part")


def redacted(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs whose text has ``mark`` in place of every span that scan() finds (overlapping spans: one mark); a null text stays null.

    An n_chars column follows the new text; all other columns stay as they are, whatever their names. Jobs run while the
    result is made.
    """
    frame, back = sheltered(docs, NEW)
    full = scan(frame, text)
    whole, old = field(full, text), free("cleared", full.columns)
    reach = lambda spans: _before(F.transform(spans, lambda x: x["e"]), F.greatest)
    parted = F.zip_with("found", reach(F.col("found")), lambda x, b: F.struct(b.alias("from"), x["s"].alias("to")))
    kept = F.transform(F.filter(parted, lambda x: x["to"] >= x["from"]), lambda x: F.substring(whole, x["from"] + 1, x["to"] - x["from"]))
    end = F.array_max(F.transform("found", lambda x: x["e"]))
    done = full.withColumn(old, F.when(F.size("found") > 0, F.array_join(F.concat(kept, F.array(F.substring(whole, end + 1, F.length(whole)))), mark)).otherwise(whole))
    columns = {text: field(done, old)} | ({"n_chars": F.length(field(done, old)).cast("long")} if "n_chars" in docs.columns else {})
    return back(done.withColumns(columns))


#: The DuckDB SQL of scan() over ``documents``, without the found column.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  {" UNION ALL ".join(f"SELECT r, {k} AS k, len(string_split_regex(t, $p${p}$p$)) AS n, regexp_extract_all(t, $p${p}$p$) AS m, regexp_extract_all(t, $p${p}$p$, {g}) AS v, string_split_regex(t, $p${p}$p$) AS g FROM d WHERE regexp_matches(t, $p${p}$p$)"
                      for k, p, g in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0), (3, IDENT, 0), (6, ENDPOINT, 0)))}
),
u AS (SELECT r, k, unnest(range(1, n)) AS i, unnest(list_transform(m, lambda x: length(x))) AS m, unnest(list_transform(v, lambda x: length(x))) AS v, unnest(list_transform(g[:n - 1], lambda x: length(x))) AS g FROM p),
w AS (SELECT r, k, m, v, sum(g + m) OVER (PARTITION BY r, k ORDER BY i) - m AS s FROM u),
x AS (SELECT r, CASE WHEN k = 0 AND v < {LEAST_ASSIGN} THEN 4 WHEN k = 2 AND m < {LEAST_HEX} THEN 5 ELSE k END AS k, s, s + m AS e FROM w),
y AS (
  SELECT * FROM x WHERE k < 3 OR (
    EXISTS (SELECT 1 FROM x o WHERE o.r = x.r AND o.k IN (1, 3) AND abs(o.s - x.s) <= {SCOPE}) AND EXISTS (SELECT 1 FROM x o WHERE o.r = x.r AND o.k IN (0, 2, 4, 5) AND abs(o.s - x.s) <= {SCOPE}))
),
z AS (SELECT r, k, s, e, {KINDS}[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS said FROM y)
SELECT doc_id, count(*) FILTER (k = 0)::BIGINT AS n_assign, count(*) FILTER (k = 1)::BIGINT AS n_access, count(*) FILTER (k = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY s, k, e), '') AS spans
FROM d LEFT JOIN z USING (r) GROUP BY r, doc_id
"""
