"""Secret scans with multipart credential linking (operator 4), in DataFrame operations only.

Base kinds are found by pattern alone (assign, access, hex). Weak candidates mean nothing on
their own: an identifier (`ident`), a short or unusually named secret (`weak`), an `endpoint`.
They are linked by an interval join within their scope, the candidates of the same text that
start within SCOPE code points: a weak secret is reported if an identifier or access key is
near, an identifier if a secret is near, an endpoint only if both are. The interval join is a
range-framed window over a text's candidates in order of position; its frames hold what fits in
2 x SCOPE code points, so nothing grows with the square of anything.

Positions come from the pieces between matches: a match starts where the pieces and matches
before it end, a running sum over the matches of a text. Text is read in place; what is shuffled
is candidates, after rows that repeat were counted where they are.

Result: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked; a row for each input row.

Defined results: null texts are empty; no span gives '' (and the hash of ''); repeated rows get a
row each; a null doc_id is kept; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCOPE = 400

# The base patterns and the order of kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run of 32 or more is what [0-9a-f]+ of 32 or more matches
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")

IDENT = r"""(?<![A-Za-z0-9_])(?i:(access_?key_?id|client_?id|user_?name|username|user|login|account|email))["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9@+/_.-]{2,}"""
WEAK = r"""(?<![A-Za-z0-9_])(?i:(pwd|pass|passphrase|credential|client_?secret|auth|private_?key|secret_?key|access_?key|password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
ENDPOINT = r"""(?<![A-Za-z0-9_])(?i:(https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3|ftp)://[A-Za-z0-9][A-Za-z0-9@:/_.?=&%-]*|(host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9:/_.-]{3,})"""


def _matches(text: Column, pattern: str, kind: int, group: int = 0, min_chars: int = 0) -> Column:
    """array<struct<kind, pos, gap, len, ok>> of the leftmost non-overlapping matches: the code points before each (after the last one) and in it; ok where the group has min_chars."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("len")))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.arrays_zip(measured.alias("m"), held.alias("g"))
    rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.m.gap.alias("gap"), x.m.len.alias("len"), (F.length(x.g) >= min_chars).alias("ok")))
    # the cheap test comes first: most texts have no match at all
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:bigint,len:bigint,ok:boolean>>"))


def candidates(text: Column) -> Column:
    """All matches of the base kinds and of the weak ones."""
    base = (_matches(text, ASSIGN, 0, 2, 8), _matches(text, ACCESS, 1, 0, 16), _matches(text, HEX, 2, 0, 32))
    return F.concat(*base, _matches(text, IDENT, 3), _matches(text, WEAK, 4), _matches(text, ENDPOINT, 5))


def _joined(where: Column) -> Column:
    """kind:start:end of a text's spans, by start, kind and end."""
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_sort(F.collect_list(F.when(where, F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.length(text).alias("size"), candidates(text).alias("c"))
    own = ["doc_id", "h", "size"]
    # rows that share doc_id and text have the same matches: one of each, and how many rows there are
    rows = found.select(*own, F.explode_outer("c").alias("m")).groupBy(*own, "m").agg(F.count(F.lit(1)).alias("n")).select(*own, "m.*", "n")

    along = W.partitionBy(*own, "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("len")).over(along)
    # matches that fail only move the position on; a text without matches has one row of nulls
    spans = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).withColumn("kind", F.when(F.col("ok"), F.col("kind")))

    near = W.partitionBy(*own).orderBy("start").rangeBetween(-scope, scope)
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    linked = spans.withColumns({"near_id": has(1, 3), "near_secret": has(0, 2, 4)})
    base = F.col("kind") <= 2
    keep = base | ((F.col("kind") == 4) & F.col("near_id")) | ((F.col("kind") == 3) & F.col("near_secret")) | ((F.col("kind") == 5) & F.col("near_id") & F.col("near_secret"))
    # a weak secret that covers a base span's own words adds nothing: the furthest end of the base spans
    # that start before it, and the nearest start of those after it, tell whether one overlaps
    up = W.partitionBy(*own).orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*own).orderBy(F.desc("start")).rangeBetween(W.unboundedPreceding, 0)
    met = linked.withColumns({"keep": keep, "base_end": F.max(F.when(base, F.col("end"))).over(up), "base_start": F.min(F.when(base, F.col("start"))).over(down)})
    covered = F.coalesce(F.col("base_end") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_start") < F.col("end"), F.lit(False))
    shown = met.withColumn("new", F.col("keep") & ~base & ~covered)
    out = shown.groupBy(*own).agg(
        F.count_if(F.col("kind") == 0).alias("n_assign"),
        F.count_if(F.col("kind") == 1).alias("n_access"),
        F.count_if(F.col("kind") == 2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(base | F.col("new")).alias("spans"),
        F.count_if("new").alias("n_linked"),
        F.max("n").alias("n_rows"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).drop("copy", "n_rows", "h", "size")


def oracle(scope: int = SCOPE) -> str:
    """The same result in DuckDB's SQL, for tables whose doc_ids do not repeat."""
    # RE2 has no look-behind; its word boundary is the ASCII one, which is the same before a letter
    forms = (ASSIGN, ACCESS, HEX, IDENT, WEAK, ENDPOINT)
    least = ("length(g) >= 8", "length(w) >= 16", "length(w) >= 32", "true", "true", "true")
    parts = []
    for kind, (form, test) in enumerate(zip(forms, least, strict=True)):
        p = form.replace("(?<![A-Za-z0-9_])", r"\b").replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {kind} AS kind, start, start + length(w) AS stop FROM (
 SELECT doc_id, w[i] AS w, g[i] AS g, CAST(length(array_to_string(s[1:i], '')) + length(array_to_string(w[1:i - 1], '')) AS BIGINT) AS start
 FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {2 if kind == 0 else 0}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(w) + 1)) AS u(i)) WHERE {test}"""
        )
    near = f"OVER (PARTITION BY doc_id ORDER BY start RANGE BETWEEN {scope} PRECEDING AND {scope} FOLLOWING)"
    names = "['" + "', '".join(KINDS) + "'][kind + 1]"
    text = lambda where: f"coalesce(string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (WHERE {where}), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS ({' UNION ALL '.join(parts)}),
 l AS (SELECT *, max(kind IN (1, 3)) {near} AS near_id, max(kind IN (0, 2, 4)) {near} AS near_secret FROM c),
 k AS (SELECT * FROM l WHERE kind <= 2 OR (kind = 4 AND near_id) OR (kind = 3 AND near_secret) OR (kind = 5 AND near_id AND near_secret)),
 o AS (SELECT k.*, EXISTS (SELECT 1 FROM k b WHERE b.doc_id = k.doc_id AND b.kind <= 2 AND b.start < k.stop AND k.start < b.stop) AS covered FROM k)
 SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
 sha256({text('kind <= 2')}) AS base_sha256, {text('kind <= 2 OR NOT covered')} AS spans, count(*) FILTER (WHERE kind > 2 AND NOT covered) AS n_linked
 FROM d LEFT JOIN o USING (doc_id) GROUP BY doc_id"""
