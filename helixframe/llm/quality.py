"""Quality classification by hierarchical empirical Bayes.

Evidence of a document: for each feature (words, trailing signs, and whether the commonest word, words
said twice or capitals have at least a tenth, two tenths, ... of the text; counted by language), its documents among the rejected and the accepted
labels give a log likelihood ratio. It counts if it speaks for rejection, at a ratio of at least
``least_ratio``, with a signed root of the likelihood-ratio statistic of at least ``least_z``, and if
at least ``least_share`` of the language's rejected have it: words that only a group of copies
shares say nothing of others. Languages with few labels, or none of a kind, lean on all languages: a
feature also counts if it does so over all labels together, against what the languages' own rates of
rejection lead to expect; and a language's own counts are joined by ``pool_weight`` documents of each
kind that have the feature as often as all languages' do. A document's evidence is the sum over its distinct features. All
labelled documents are counted.

Levels: features are not independent, and long texts hold more of them by chance, so evidence is not
yet a probability. Documents of one level (whole part of the evidence) have the rate of rejection
that the labelled ones of the level show, shrunk by ``level_weight`` documents to what independent
features would give; those of one level and size (whole part of the binary logarithm of the number
of distinct features) that of their own labelled ones, shrunk likewise to the level's. For that the
labelled documents' own evidence is out of fold: labels are dealt into FOLDS by their ids, and a
document's evidence comes from the labels of the other folds. So levels show what evidence is worth
on documents that it was not found in.

Sites: a document's host and path (of its source; the language is the path's last part) have rates
of rejection, summed over the levels' rates of all their documents, labelled or not. The host's rate
is shrunk to the global one and the path's to the host's, by a prior weight from the method of
moments between groups, so sparse sites stay near the global rate. The path's posterior replaces the
global rate in the document's odds.

All of that is grouped aggregation of sums; hosts and paths meet documents in joins that adaptive
execution may split. Only the significant features are broadcast: each is in ``least_share`` of a
language's rejected documents, so there are at most the mean number of features of those documents,
divided by ``least_share``, for each language and for all together.

Defined cases: a null or empty text has no features, so no evidence; a null source or language is
"" at its level; labels of unknown documents, null ids or null values teach nothing; several labels
of a document count each; without labels no evidence is found and nothing is rejected; rows with
null ids are scored, and kept by ``accepted``; rows that share an id are judged one by one; an empty table gives no rows; other columns are
ignored by ``classify`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, columns_as, map_batches, saved

BROADCAST_ROWS = 1_000_000
SIGNS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")
CAPITALS = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
#: Prior weight of a site level where the groups cannot tell it.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1e6


#: Level of the highest evidence: odds of 5e8, beyond which no rate could be told apart.
TOP_LEVEL = 20
#: Parts of the labels, of which one is left out when its own documents' evidence is taken.
FOLDS = 3
#: Features that a task counts at once.
RUN_FEATURES = 2_000_000


def features(text: bytes) -> np.ndarray:
    """64-bit hashes, sorted, of the distinct features of a text."""
    import xxhash

    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    counts = Counter(words)
    names = {b"w " + w.lower() for w in counts}
    names |= {b"s " + m[0] for w in counts if (m := SIGNS.search(w))}
    if len(words) >= 10:
        big, small = (len(text) - len(text.translate(None, x)) for x in (CAPITALS, SMALL))
        shares = (b"r", max(counts.values()), len(words)), (b"d", sum(map(bytes.__eq__, words, words[1:])), len(words)), (b"u", big, max(big + small, 1))
        names.update(b"%b %d" % (kind, k) for kind, n, of in shares for k in range(1, 10 * n // of + 1))
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(x) for x in names), np.uint64, len(names)).view(np.int64))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that have a label, with ``bad``: quality 0 or toxic 1."""
    marks = labels.where("doc_id is not null and quality is not null and toxic is not null")
    marks = marks.select(F.col("doc_id").alias("label_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    small = marks.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(marks) if small else marks, F.col("doc_id") == F.col("label_id")).drop("label_id")


Weights = dict[str | None, tuple[np.ndarray, np.ndarray]]


def fold_of(doc_id: str):
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)), F.lit(0)).cast("int")


def counted(rows: DataFrame) -> DataFrame:
    """(lang, feature, good0, bad0, good1, ...), saved: by fold, the labelled documents with a feature, or with any (null). ``rows``: (text, lang, bad, fold)."""
    names = [f"{kind}{k}" for k in range(FOLDS) for kind in ("good", "bad")]

    def flushed(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            keys, at = np.unique(np.concatenate([f for f, _ in found]), return_inverse=True)
            cell = np.array([c for _, c in found])
            own = np.repeat(cell, [len(f) for f, _ in found])
            counts = [np.append(np.bincount(at[own == c], minlength=len(keys)), (cell == c).sum()).astype(np.int64) for c in range(2 * FOLDS)]
            features = pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(features)), features, *map(pa.array, counts)], names=["lang", "feature", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0  # several documents together, so that each feature is sent once for them
        for batch in batches:
            for text, lang, bad, fold in zip(as_bytes(column(batch, "text")), *(column(batch, c).to_pylist() for c in ("lang", "bad", "fold"))):
                found = features(text)
                held.setdefault(lang or "", []).append((found, 2 * fold + bad))
                n += len(found)
                if n >= RUN_FEATURES:
                    yield from flushed(held)
                    held, n = {}, 0
        yield from flushed(held)

    counts = rows.select("text", "lang", "bad", "fold").mapInArrow(run, "lang string, feature long, " + ", ".join(f"{x} long" for x in names))
    return saved(counts.groupBy("lang", "feature").agg(*(F.sum(x).alias(x) for x in names)), "features")


def left_out(counts: DataFrame, prefix: str = "") -> list:
    """For each fold left out (-1: none): good and bad columns of ``counts``."""
    total = lambda kind, k: sum((F.col(f"{prefix}{kind}{j}") for j in range(FOLDS) if j != k), F.lit(0))
    return [(k, total("good", k), total("bad", k)) for k in range(-1, FOLDS)]


def weights(rows: DataFrame, least_ratio: float, least_z: float, least_share: float, pool_weight: float) -> dict[int, Weights]:
    """By fold left out (-1: none), then by language, and under None for languages without labels: the features that count, sorted, and their log likelihood ratios of rejection."""
    counts = counted(rows)
    kinds = [c for c in counts.columns if c not in ("lang", "feature")]
    totals = counts.where("feature is null").collect()
    all_of = {k: {r["lang"]: (sum(r[f"good{j}"] for j in range(FOLDS) if j != k), sum(r[f"bad{j}"] for j in range(FOLDS) if j != k)) for r in totals} for k in range(-1, FOLDS)}
    own = counts.where("feature is null").select("lang", *(F.col(c).alias(f"all_{c}") for c in kinds))
    x = counts.where("feature is not null").join(F.broadcast(own), "lang")

    # Significant: more rejected than the languages' own shares lead to expect; in one language, or in all together
    term = lambda c, e: F.when((c > 0) & (e > 0), c * F.log(c / e)).otherwise(0.0)

    def significant(good, bad, expected, all_good, all_bad):
        root = F.sqrt(F.greatest(2 * (term(bad, expected) + term(good, good + bad - expected)), F.lit(0.0)))
        ratio = F.log((bad + 0.5) / (all_bad + 1.0)) - F.log((good + 0.5) / (all_good + 1.0))
        return (bad > 0) & (bad >= least_share * all_bad) & (ratio >= math.log(least_ratio)) & (root >= least_z)

    expected = {k: F.coalesce(F.try_divide((good + bad) * b, b + g), F.lit(0.0)) for (k, good, bad), (_, g, b) in zip(left_out(x), left_out(x, "all_"))}
    in_one = F.array(*(F.when((g > 0) & (b > 0) & significant(good, bad, expected[k], g, b), F.lit(k)) for (k, good, bad), (_, g, b) in zip(left_out(x), left_out(x, "all_"))))
    by_feature = x.groupBy("feature").agg(*(F.sum(c).alias(c) for c in kinds), *(F.sum(e).alias(f"e{k + 1}") for k, e in expected.items()))
    sums = {k: (sum(g for g, _ in of.values()), sum(b for _, b in of.values())) for k, of in all_of.items()}
    in_all = F.array(*(F.when(significant(good, bad, F.col(f"e{k + 1}"), F.lit(sums[k][0]), F.lit(sums[k][1])) & (bad > F.col(f"e{k + 1}")), F.lit(k)) for k, good, bad in left_out(by_feature)))
    chosen = x.select("lang", "feature", F.explode(F.array_compact(in_one)).alias("without"))
    chosen = saved(chosen.unionByName(by_feature.select(F.lit(None).cast("string").alias("lang"), "feature", F.explode(F.array_compact(in_all)).alias("without"))), "chosen")
    cells = x.join(F.broadcast(chosen.select("feature").distinct()), "feature", "left_semi").select("lang", "feature", *kinds).toArrow()
    chosen = chosen.toArrow()
    numbers = {c: cells[c].to_numpy() for c in kinds}
    out = {}
    for k in range(-1, FOLDS):
        good, bad = (sum(numbers[f"{kind}{j}"] for j in range(FOLDS) if j != k) for kind in ("good", "bad"))
        own_cells = pa.table({"lang": cells["lang"], "feature": cells["feature"], "good": good, "bad": bad})
        mine = chosen.filter(pc.equal(chosen["without"], k))
        own_cells = own_cells.filter(pc.is_in(own_cells["feature"], mine["feature"].combine_chunks()))
        out[k] = _pooled(mine, own_cells, all_of[k], least_ratio, pool_weight)
    return out


def _pooled(chosen: pa.Table, cells: pa.Table, totals: dict[str, tuple[int, int]], least_ratio: float, pool_weight: float) -> Weights:
    """Each language's counts of the chosen features, with ``pool_weight`` documents of each kind that are as the pooled ones."""
    all_good, all_bad = (sum(x) for x in zip(*totals.values())) if totals else (0, 0)
    names = np.unique(chosen["feature"].to_numpy())
    at, of = np.searchsorted(names, cells["feature"].to_numpy()), np.array(cells["lang"].to_pylist(), object)
    good, bad = cells["good"].to_numpy(), cells["bad"].to_numpy()
    rate = [(np.bincount(at, weights=c, minlength=len(names)) + 0.5) / (k + 1.0) for c, k in ((good, all_good), (bad, all_bad))]
    picked: dict[str | None, np.ndarray] = {lang: np.zeros(len(names), bool) for lang in (None, *totals)}
    for lang, i in zip(chosen["lang"].to_pylist(), np.searchsorted(names, chosen["feature"].to_numpy())):
        picked[lang][i] = True
    out: Weights = {None: (names[picked[None]], np.log(rate[1] / rate[0])[picked[None]])}
    for lang, k in totals.items():
        mine = of == lang
        own_rate = [(np.bincount(at[mine], weights=c[mine], minlength=len(names)) + 0.5 + pool_weight * r) / (m + 1.0 + pool_weight) for c, m, r in zip((good, bad), k, rate)]
        value = np.log(own_rate[1] / own_rate[0])
        keep = (picked[lang] | picked[None]) & (value >= math.log(least_ratio))
        out[lang] = names[keep], value[keep]
    return out


def evidence(rows: DataFrame, found: dict[int, Weights], passed: list[str]) -> DataFrame:
    """``passed`` columns of ``rows``, the evidence of ``text``, that of the labels of other folds, and the size."""
    sent = rows.sparkSession.sparkContext.broadcast(found)

    def of(weights: Weights, lang: str | None, at: np.ndarray) -> float:
        names, values = weights.get(lang or "", weights[None])
        if not len(at) or not len(names):
            return 0.0
        return float(values[at[np.minimum(np.searchsorted(at, names), len(at) - 1)] == names].sum())

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        sums, others, sizes = [], [], []
        for text, lang, fold in zip(as_bytes(column(batch, "text")), column(batch, "lang").to_pylist(), column(batch, "fold").to_pylist()):
            at = features(text)
            sums.append(of(sent.value[-1], lang, at))
            others.append(of(sent.value[fold], lang, at))
            sizes.append(len(at).bit_length())
        yield {c: column(batch, c) for c in passed} | {"evidence": sums, "other_evidence": others, "size": sizes}

    schema = rows.select(*passed).schema.add("evidence", "double").add("other_evidence", "double").add("size", "integer")
    return map_batches(rows.select("text", "lang", "fold", *passed), lambda: step, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


def shrunk(groups: DataFrame, up: str) -> DataFrame:
    """``groups`` (n, mass, ``up``) with ``rate``: mass / n shrunk to ``up``, a column with the level above's rate."""
    spread = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(up)).alias("m"), F.sum(F.col("n") * (F.col("mass") / F.col("n") - F.col(up)) ** 2).alias("between"), F.sum(F.col("n") ** 2).alias("nn")).first()
    weight = MOST_WEIGHT
    if spread["k"] and spread["n"]:
        mean = min(max(spread["m"] / spread["n"], 1e-9), 1 - 1e-9)
        within = mean * (1 - mean)
        apart = (spread["between"] - spread["k"] * within) / max(spread["n"] - spread["nn"] / spread["n"], 1e-9)
        weight = min(max(within / apart - 1, LEAST_WEIGHT), MOST_WEIGHT) if apart > 0 else MOST_WEIGHT
    return groups.withColumn("rate", (F.col("mass") + weight * F.col(up)) / (F.col("n") + weight))


def logit(x):
    p = F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def rates(seen: list, weight: float) -> tuple[float, dict[str, float], dict[str, float]]:
    """The labels' log odds of rejection, the levels' rates and those of (level, size) of rows with level, size, n, bad and sum (of evidence)."""
    n, bad = sum(r["n"] for r in seen), sum(r["bad"] for r in seen)
    prior = math.log((bad + 0.5) / (n - bad + 0.5))
    by_level: dict[str, float] = {}
    for k in {r["level"] for r in seen}:
        own = [r for r in seen if r["level"] == k]
        m = sum(r["n"] for r in own)
        alone = 1 / (1 + math.exp(-prior - sum(r["sum"] for r in own) / m))
        by_level[str(k)] = (sum(r["bad"] for r in own) + weight * alone) / (m + weight)
    return prior, by_level, {f"{r['level']}:{r['size']}": (r["bad"] + weight * by_level[str(r["level"])]) / (r["n"] + weight) for r in seen}


def row_key(text: str, source: str, lang: str) -> Column:
    """A hash of what a row is judged by; rows of one id that differ in it are judged apart."""
    return F.xxhash64(*(x for c in (text, source, lang) for x in (F.col(c), F.col(c).isNull())))


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, p_reject, rejected) for every row."""
    return judged(docs, labels, **how).drop("row")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, least_ratio: float = 10.0, least_z: float = 4.0, least_share: float = 0.02, level_weight: float = 5.0, pool_weight: float = 5.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """What ``classify`` gives, with ``row``, the ``row_key``. ``threshold`` is above a half, since a good document lost costs more than a bad one kept."""
    rows = columns_as(docs, doc_id=id_col, text=text_col, source=source_col, lang=lang_col)
    source = F.coalesce("source", F.lit(""))
    rows = rows.select("doc_id", "text", "lang", row_key("text", "source", "lang").alias("row"), F.regexp_extract(source, r"^(?:[A-Za-z]+://)?([^/?#]*)", 1).alias("host"), F.concat_ws("/", F.regexp_replace(source, r"/[^/]*$", ""), F.coalesce("lang", F.lit(""))).alias("path"), fold_of("doc_id").alias("fold"))
    found = weights(labelled(rows.select("doc_id", "text", "lang", "fold"), labels), least_ratio, least_z, least_share, pool_weight)
    scored = saved(evidence(rows, found, ["doc_id", "row", "host", "path"]), "evidence")

    level, other = (F.least(F.floor(c), F.lit(TOP_LEVEL)).alias("level") for c in ("evidence", "other_evidence"))
    seen = labelled(scored.select("doc_id", "other_evidence", "size"), labels).groupBy(other, "size").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.sum("other_evidence").alias("sum")).collect()
    prior, by_level, by_cell = rates(seen, level_weight)
    shown = [F.create_map(*(F.lit(x) for r in found.items() for x in r)) if found else F.create_map().cast("map<string,double>") for found in (by_cell, by_level)]
    cell = F.concat_ws(":", level.cast("string"), F.col("size").cast("string"))
    alone = scored.withColumn("p", F.coalesce(F.try_element_at(shown[0], cell), F.try_element_at(shown[1], level.cast("string")), 1 / (1 + F.exp(-(F.lit(prior) + F.col("evidence"))))))

    paths = saved(alone.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("mass")), "paths")
    overall = paths.agg(F.sum("mass"), F.sum("n")).first()
    base = overall[0] / overall[1] if overall[1] else 0.5
    hosts = shrunk(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).withColumn("up", F.lit(float(base))), "up").select("host", F.col("rate").alias("host_rate"))
    sites = shrunk(paths.join(hosts, "host"), "host_rate").select("host", "path", "host_rate", F.col("rate").alias("path_rate"))

    final = logit(F.col("p")) + logit(F.col("path_rate")) - logit(F.lit(float(base)))
    out = alone.join(sites, ["host", "path"]).withColumn("p_reject", 1 / (1 + F.exp(-final)))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", "p_reject", (F.col("p_reject") > threshold).alias("rejected"), "row")


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, lang, ...) that are not rejected. A row goes by its own text, source and language, whatever other rows of its id say; rows with null ids stay."""
    gone = saved(judged(docs, labels, **how).where("rejected and doc_id is not null").select("doc_id", "row").distinct(), "rejected")
    small = gone.count() <= BROADCAST_ROWS
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no column clashes with the key
    at = {c: f"c{names.index(c)}" for c in ("doc_id", "text", "source", "lang")}
    keyed = plain.withColumns({"doc_id": F.col(at["doc_id"]), "row": row_key(at["text"], at["source"], at["lang"])})
    left = keyed.join(F.broadcast(gone) if small else gone, ["doc_id", "row"], "left_anti")
    return left.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
