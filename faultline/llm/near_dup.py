"""MinHash near-dedup by ProbMinHash (operator 5).

Text -> words (folded, ASCII punctuation separates) -> shingles of five words, weighted by how
often the text has them.

1. Sketch. Each shingle of weight w is a Poisson process of rate w, seeded by the shingle's hash;
   every arrival falls on one of M registers, which keeps its earliest arrival's shingle. A text's
   arrivals beyond the time at which all registers are filled cannot matter, so elements stop
   there (early termination). Two sketches agree in a register with the probability Jaccard
   similarity of the weighted sets. A text that repeats shingles has a second sketch with all
   weights 1, which agrees with the Jaccard similarity, so that either measure has candidates.
2. Copies. Texts with equal shingles share a key; one row for each key goes on.
3. Banding. BANDS x ROWS registers; equal bands meet in a bucket. A bucket's members pair with its
   smallest key; these pairs are verified and joined into components. Pairs within a component
   cannot change a class and are not tried.
4. Buckets whose members the hub left in several components give the rest of their pairs exactly,
   without trying all: texts can only reach the threshold if they share one of their first
   shingles, in an order that puts those of few texts first, and if what follows it is long
   enough in both (`prefixes`). First the representatives of components meet by such shingles,
   then each text meets representatives, then, among what is left apart, every text.
5. Verification on the exact shingle sets: a pair is a link if its Jaccard or its probability
   Jaccard similarity is at least `threshold`.
6. Components by label propagation with pointer jumping, all in tables.

Result: a row for each input row with class_id, the smallest doc_id of its class, and n_links,
the number of links verified at its text (copies not counted).

Defined results: null, empty and word-less texts are in no class but their own (class_id is
their doc_id); a text of one to four words has one shingle, all of its words; repeated rows get
a row each; null doc_ids are never chosen as class_id unless the class has no other; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.shared import Scratch, saved, small, texts_in_batches
from faultline.llm.textkernel import NON_WORD, U64, mix, shingles, slices, words

K, BANDS, ROWS = 5, 24, 6
M = BANDS * ROWS
_GOLD = U64(0x9E3779B97F4A7C15)


def weighted_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, offsets): each text's distinct shingles in ascending order."""
    s, doc = shingles(words(texts, NON_WORD), K)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(doc[at], np.arange(len(texts) + 1))


def prob_minhash(s: np.ndarray, weight: np.ndarray, offsets: np.ndarray, m: int = M) -> np.ndarray:
    """For each text m registers, each the shingle of its earliest arrival (0 if the text has none)."""
    n_docs = len(offsets) - 1
    sketch = np.zeros((n_docs, m), U64)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), counts)
    total = np.bincount(doc, weight, n_docs)
    todo = counts > 0
    bound = (np.log(m) + 3) * m / np.maximum(total, 1e-300)
    while todo.any():
        on = np.flatnonzero(todo[doc])
        e_doc, e_seed, e_rate, t = doc[on], s[on], weight[on].astype(np.float64), np.zeros(len(on))
        times, slots, seeds, j = [], [], [], 0
        while len(e_doc):
            j += 1
            x = mix(e_seed + U64(int(_GOLD) * j & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((x >> U64(24)).astype(np.float64) + 0.5) * 2.0**-40) / e_rate
            early = t < bound[e_doc]
            e_doc, e_seed, e_rate, t, x = e_doc[early], e_seed[early], e_rate[early], t[early], x[early]
            times.append(t)
            slots.append(e_doc * m + (((x & U64(0xFFFFFF)) * U64(m)) >> U64(24)).astype(np.int64))
            seeds.append(e_seed)
        order = np.argsort(-np.concatenate(times), kind="stable")
        sketch.ravel()[np.concatenate(slots)[order]] = np.concatenate(seeds)[order] | U64(1)  # the earliest is written last
        todo &= (sketch == 0).any(1)
        bound *= 2
    return sketch


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))  # a band's number is part of its keys
    for r in range(rows):
        out = mix(out * U64(3) + sketch[:, r::rows][:, :bands])
    return out.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, key1, key2, n, bands, shingles, counts): n distinct shingles as 64-bit hashes; counts is empty if all are 1. n is 0 and bands is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                s, c, offs = weighted_sets(batch.column(2).slice(i, j - i))
                n = np.diff(offs)
                has, doc = n > 0, np.repeat(np.arange(j - i), n)
                pair = mix(s * U64(7) + mix(c.astype(U64)))
                sums = np.zeros((2, len(s) + 1), U64)
                np.cumsum(pair, out=sums[0, 1:])
                np.cumsum(mix(pair + _GOLD), out=sums[1, 1:])
                key = (sums[:, offs[1:]] - sums[:, offs[:-1]]).view(np.int64)
                many = np.bincount(doc, c > 1, j - i) > 0
                sketch = [band_keys(prob_minhash(s, np.ones(len(s)), offs))[has]]  # where no shingle repeats it is the weighted one
                if many.any():
                    on = many[doc]
                    sketch.append(band_keys(prob_minhash(s[on], c[on], np.concatenate([[0], np.cumsum(n[many])]))))
                of = np.concatenate([np.flatnonzero(has), np.flatnonzero(many)])[: sum(map(len, sketch))]
                bands = np.concatenate(sketch)[np.argsort(of, kind="stable")]
                at = np.concatenate([[0], np.cumsum(np.where(many, n, 0))])
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(key[0]), pa.array(key[1]), pa.array(n.astype(np.int32)), _lists(bands.ravel(), np.concatenate([[0], np.cumsum((has * 1 + many) * BANDS)]), pa.int64()), _lists(s.view(np.int64), offs, pa.int64()), _lists(c[many[doc]].astype(np.int32), at, pa.int32())],
                    ["doc_id", "text_hash", "key1", "key2", "n", "bands", "shingles", "counts"],
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text).mapInArrow(run, "doc_id long, text_hash long, key1 long, key2 long, n int, bands array<long>, shingles array<long>, counts array<int>")


def prob_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of aligned weights: the sum over i of 1 / sum_j max(a_j / a_i, b_j / b_i), by sorting a_i / b_i."""
    both = (a > 0) & (b > 0)
    ratio = a[both] / b[both]
    order = np.argsort(ratio, kind="stable")
    x, y, r = a[both][order], b[both][order], ratio[order]
    # max(a_j / a_i, b_j / b_i) is a_j / a_i where a_j / b_j >= a_i / b_i, else b_j / b_i
    below_b, from_a = np.cumsum(y) - y, np.cumsum(x[::-1])[::-1]
    only_a, only_b = a[b == 0].sum(), b[a == 0].sum()
    return float(np.sum(1 / ((from_a + only_a) / x + (below_b + only_b) / y))) if len(r) else 0.0


def similarity(sa: np.ndarray, ca: np.ndarray, sb: np.ndarray, cb: np.ndarray) -> float:
    """The larger of Jaccard and probability Jaccard."""
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    union = len(sa) + len(sb) - len(both)
    plain = len(both) / union if union else 0.0
    if not len(both) or (not len(ca) and not len(cb)):
        return plain
    ca, cb = ca if len(ca) else np.ones(len(sa)), cb if len(cb) else np.ones(len(sb))
    only_a, only_b = np.delete(ca, ia), np.delete(cb, ib)
    a = np.concatenate([ca[ia], only_a, np.zeros(len(only_b))]).astype(np.float64)
    b = np.concatenate([cb[ib], np.zeros(len(only_a)), only_b]).astype(np.float64)
    return max(plain, prob_jaccard(a, b))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. Pairs are few for each text, so both joins are by key."""
    named = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(2, 6)]
            keep = np.zeros(len(batch), bool)
            flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in cols]
            for k in range(len(batch)):
                keep[k] = similarity(*(v[o[k] : o[k + 1]] for v, o in flat)) >= threshold
            keep = pa.array(keep)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    joined = pairs.join(named("a"), "a").join(named("b"), "b").select("a", "b", "sa", "ca", "sb", "cb")
    return joined.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, tmp: Scratch) -> DataFrame:
    """(id, comp): the smallest id that can be reached. Each round takes the smallest neighbouring label, then the label's own label; tables are written, nothing is gathered."""
    both = tmp.saved(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = tmp.saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        now = tmp.saved(step.join(jump, "comp").select("id", "was", F.least("comp", "next").alias("comp")), "labels")
        labels = now.select("id", "comp")
        if now.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def _joined_by(comp: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    """comp (id, comp) after more links: the components themselves are joined, which few edges tell."""
    own = comp.select(F.col("id").alias("of"), "comp")
    ends = links.join(own.withColumnRenamed("comp", "ca"), F.col("a") == F.col("of"), "left").drop("of").join(own.withColumnRenamed("comp", "cb"), F.col("b") == F.col("of"), "left")
    edges = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    now = components(edges, tmp)
    moved = comp.join(now.select(F.col("id").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    return moved.unionByName(now.join(comp, "id", "left_anti"))  # texts that had no link before


def prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """(token, id, n, left, mass, lead): the shingles by which texts (id, shingles, counts) find their partners.

    Shingles are put in one order for all texts, those of few texts first. `left` counts a text's
    shingles from this one on, `mass` is their share of its weight. What lies before the first
    shingle that a pair shares is in one of them only, so it bounds both similarities:
    min(left, left') must reach t / (1 + t) (n + n') for Jaccard, and 1 / mass + 1 / mass' must not
    exceed 1 + 1 / t for probability Jaccard (the registers that fall outside of what is shared: at
    least u / (1 - u) + v / (1 - v) times those within, u and v being the masses before it). So each
    share is at least t, and one of the two is at least 2 t / (1 + t): that row leads.
    Shingles of one text have no partner and are left out.
    """
    each = texts.select("id", F.explode(F.arrays_zip("shingles", "counts")).alias("s")).select("id", F.col("s.shingles").alias("token"), F.coalesce("s.counts", F.lit(1)).alias("w"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    from_end = W.partitionBy("id").orderBy(F.desc(F.coalesce("df", F.lit(1))), F.desc("token"))
    whole = W.partitionBy("id")
    placed = each.join(shared, "token", "left").withColumns({"left": F.row_number().over(from_end), "weight": F.sum("w").over(from_end.rowsBetween(W.unboundedPreceding, 0)), "n": F.count(F.lit(1)).over(whole), "total": F.sum("w").over(whole)})
    share, mass = F.col("left") / F.col("n") + 1e-9, F.col("weight") / F.col("total") + 1e-9
    kept = placed.where(F.col("df").isNotNull() & (F.greatest(share, mass) >= threshold))
    return kept.select("token", "id", "n", "left", mass.alias("mass"), (F.greatest(share, mass) >= 2 * threshold / (1 + threshold)).alias("lead"))


def _crossing(leads: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts of different components that share a prefix shingle which may be their first. What is made are such pairs; texts of one component do not meet."""

    def can(n: str, left: str, mass: str, plain: str) -> F.Column:
        by_number = F.least("left", left) + 1e-6 >= threshold / (1 + threshold) * (F.col("n") + F.col(n))
        return by_number | (~(F.col("plain") & F.col(plain)) & (1 / F.col("mass") + 1 / F.col(mass) <= 1 + 1 / threshold + 1e-6))

    others = rows.groupBy("token", "comp").agg(F.min("n").alias("n2"), F.max("left").alias("left2"), F.max("mass").alias("mass2"), F.min("plain").alias("plain2")).withColumnRenamed("comp", "comp2")
    toward = leads.join(others, "token").where((F.col("comp") != F.col("comp2")) & can("n2", "left2", "mass2", "plain2"))
    toward = toward.select("token", "id", "n", "left", "mass", "plain", "comp2")
    partner = rows.select("token", F.col("id").alias("id3"), F.col("comp").alias("comp2"), F.col("n").alias("n3"), F.col("left").alias("left3"), F.col("mass").alias("mass3"), F.col("plain").alias("plain3"))
    met = toward.join(partner, ["token", "comp2"]).where(can("n3", "left3", "mass3", "plain3"))
    return met.select(F.least("id", "id3").alias("a"), F.greatest("id", "id3").alias("b")).distinct()


def _representatives(rows: DataFrame) -> DataFrame:
    """One row for each shingle and component: the one with most behind it."""
    row = F.struct("mass", "id", "n", "left", "plain")
    return rows.groupBy("token", "comp").agg(F.max(row).alias("r")).select("token", "comp", "r.*")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, with_hash: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links) for each row, and text_hash, Spark's xxhash64 of the text, on demand; see the module's text."""
    own = ["doc_id", "text_hash"] if with_hash else ["doc_id"]
    texts_in_batches(docs.sparkSession)
    key = F.concat(F.unhex(F.lpad(F.hex("key1"), 16, "0")), F.unhex(F.lpad(F.hex("key2"), 16, "0")))
    with Scratch(docs.sparkSession) as tmp:
        sk = tmp.saved(sketches(docs), "sketches").withColumn("id", key)
        wordy = sk.where("n > 0")
        uniq = tmp.saved(wordy.select("id", F.array_distinct("bands").alias("bands")).dropDuplicates(["id"]), "distinct-texts")
        met = uniq.select("id", F.explode("bands").alias("bkey"))
        buckets = met.groupBy("bkey").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
        met = tmp.saved(met.join(buckets, "bkey"), "buckets")

        pairs = tmp.saved(met.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
        members = met.select("id").distinct()
        sets = tmp.saved(wordy.join(small(members, members.count()), "id", "left_semi").select("id", "shingles", "counts").dropDuplicates(["id"]), "sets")
        links = tmp.saved(_verified(pairs, sets, threshold), "verified")
        comp = components(links, tmp)

        # what the hubs left apart: a bucket's members but the hub, which met all
        mixed = met.where("id != hub").select("bkey", "id").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        several = mixed.groupBy("bkey").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bkey")
        apart = tmp.saved(mixed.join(several, "bkey", "left_semi").select("id").distinct(), "apart")
        if not apart.isEmpty():
            own_sets = sets.join(apart, "id", "left_semi")
            plain = own_sets.select("id", (F.size("counts") == 0).alias("plain"))
            rows = tmp.saved(prefixes(own_sets, threshold).join(plain, "id"), "prefixes")
            for part in ("representatives", "texts with representatives", "texts"):
                now = rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
                leads = now.where("lead")
                leads = _representatives(leads) if part == "representatives" else leads
                more = _crossing(leads, now if part == "texts" else _representatives(now), threshold)
                more = tmp.saved(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
                late = tmp.saved(_verified(more, sets, threshold), "verified")
                pairs, links = pairs.unionByName(more), links.unionByName(late)
                if not late.isEmpty():
                    comp = tmp.saved(_joined_by(comp, late, tmp), "components")

        ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
        named = comp.join(ends, "id")
        low = wordy.groupBy("id").agg(F.min("doc_id").alias("low"))
        of_text = low.join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        classes = of_text.groupBy("comp").agg(F.min("low").alias("class_id"))
        of_text = of_text.join(classes, "comp").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        copies = wordy.select(*own, "id").join(of_text, "id").select(*own, "class_id", "n_links")
        alone = sk.where("n = 0").select(*own, F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return saved(copies.unionByName(alone), "near-duplicates")


def oracle(threshold: float = 0.8) -> str:
    """(doc_id, class_id) in DuckDB's SQL, by every pair of texts that share a shingle; for tables whose doc_ids do not repeat."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS w FROM documents),
 s AS (SELECT doc_id, s, CAST(count(*) AS DOUBLE) AS c FROM (SELECT doc_id, array_to_string(w[i:i + {K - 1}], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - {K - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0) GROUP BY ALL),
 n AS (SELECT doc_id, count(*) AS n, sum(c) AS t FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n, sum(a.c) AS ca, sum(b.c) AS cb, sum(least(a.c / m.t, b.c / k.t)) AS least_sum FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n m ON m.doc_id = a.doc_id JOIN n k ON k.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id),
 q AS (SELECT p.*, both_n / (m.n + k.n - both_n) AS j, m.t AS ta, k.t AS tb FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b),
 c AS (SELECT q.a, q.b, q.ta - q.ca AS only_a, q.tb - q.cb AS only_b, x.s, x.c AS x, y.c AS y FROM q JOIN s x ON x.doc_id = q.a JOIN s y ON y.doc_id = q.b AND y.s = x.s WHERE j < {threshold} AND least_sum >= {threshold} - 1e-9),
 g AS (SELECT a, b, sum(1 / share) AS jp FROM (SELECT i.a, i.b, i.s, sum(greatest(o.x / i.x, o.y / i.y)) + any_value(i.only_a / i.x + i.only_b / i.y) AS share FROM c i JOIN c o ON o.a = i.a AND o.b = i.b GROUP BY i.a, i.b, i.s) GROUP BY a, b),
 e AS (SELECT a, b FROM q WHERE j >= {threshold} UNION ALL SELECT a, b FROM g WHERE jp >= {threshold}),
 l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
 SELECT doc_id, coalesce(least(doc_id, min(r.b)), doc_id) AS class_id FROM d LEFT JOIN r ON r.a = doc_id GROUP BY doc_id"""
