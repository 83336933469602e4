"""Quality classifier by hierarchical empirical Bayes.

For each label (quality, and toxic if there is one) three sources of evidence are combined in log-odds:

* the document itself: a logistic model of its layout and its byte pairs or telling words, whichever halves of
  the labelled rows foretell the other half better by; trained on at most TRAIN of them;
* its host: the posterior mean of the host, from its documents' labels and, for those without, their model
  scores (SCORED of a label each), shrunk towards the corpus;
* its path within the host: the same over the path's documents, shrunk towards the host.

Shrinkage is empirical Bayes on the beta-binomial: the prior strength of a level is found by moments from the
spread of its groups' means, so sparse hosts and paths stay near the level above while large ones speak for
themselves. What a site's log-odds count beside the document's is fitted on the labelled rows too, each half
judged by the model and the sites of the other. All means are grouped aggregates over every document and every
label; the model is a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, lean
from tidemark.llm.shingles import word_hashes

#: Labelled rows used to train, the hashed byte pairs and the words (those that tell most) that describe a text.
TRAIN, PAIRS, WORDS = 6000, 256, 256
#: Labelled texts that a word must be in, and chi-squared from which that is no chance among 100,000 words.
SEEN, TELLS = 5, 30.0
#: What a scored document counts beside a labelled one in its site, and the weight of a site's log-odds that
#: the fitted one is drawn to.
SCORED, SITE_WEIGHT = 0.2, 0.5
#: Prior strengths lie between these, in documents; that of the sites on which the weight is fitted.
WEAK, STRONG, FITTED = 1.0, 1000.0, 20.0

_KINDS = np.zeros((8, 256), np.uint8)
for _k, _test in enumerate((lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", str.isdigit, lambda c: c in " \t", lambda c: c in "\r\n", lambda c: c in ".,;:'-", lambda c: c in "!?", lambda c: 32 < ord(c) < 127 and not c.isalnum() and c not in ".,;:'-!?")):
    _KINDS[_k] = [i < 128 and _test(chr(i)) for i in range(256)]
LAYOUT = len(_KINDS) + 6


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, layout, and byte pairs of a whole text; all zero but the last-but-PAIRS for an empty one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(LAYOUT + PAIRS)
    n = len(data)
    if not n:
        out[LAYOUT - 1] = 1.0
        return out
    seen = np.bincount(data, minlength=256)
    out[: len(_KINDS)] = _KINDS @ seen / n
    words = max(1, int(np.count_nonzero((data[1:] <= 32) & (data[:-1] > 32))) + (data[-1] > 32))
    lines = text.split("\n")
    out[len(_KINDS) :] [:5] = min(3.0, n / words / 10), np.log1p(n) / 10, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, np.count_nonzero(seen) / 100
    if n > 1:
        pairs = (data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(2654435761) >> np.uint32(24)
        out[LAYOUT:] = np.sqrt(np.bincount(pairs % PAIRS, minlength=PAIRS) / (n - 1))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and weights with the intercept last, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), ridge * len(a) * np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[c for c in range(128) if not chr(c).isalnum()]] = 32


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, without punctuation and case."""
    return word_hashes(_BLANK[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)])[0]


def word_set(text: str | None) -> np.ndarray:
    return np.unique(hashes_of(text))


def telling(sets: list[np.ndarray], y: np.ndarray, most: int = WORDS) -> np.ndarray:
    """The words whose presence tells most of y, by chi-squared, of those that tell anything; of equals those of
    smaller hash."""
    words, at = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    label = np.repeat(y, [len(s) for s in sets])
    has, good = np.bincount(at, minlength=len(words)), np.bincount(at, label, len(words))
    n, share = len(y), y.mean()
    chi = (good - has * share) ** 2 * n / (np.maximum(has * (n - has), 1) * share * (1 - share))
    chi[(has < SEEN) | (chi < TELLS)] = 0
    order = np.lexsort((words, -chi))[:most]
    return np.sort(words[order[chi[order] > 0]])


def described(texts: list[str | None], models: list) -> list[np.ndarray]:
    """For each model layout, and which of its words a text has; byte pairs where it has no words."""
    out = [[] for _ in models]
    for text in texts:
        x, own = features(text), None
        for rows, words in zip(out, models):
            if words is None:
                rows.append(x)
                continue
            if own is None:
                own = hashes_of(text)
            has = np.zeros(len(words))
            at = np.minimum(np.searchsorted(words, own), len(words) - 1)
            has[at[words[at] == own]] = 1
            rows.append(np.concatenate([x[:LAYOUT], has]))
    return [np.stack(rows).astype("<f4").astype(float) for rows in out]


def probability(x: np.ndarray, model) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def logit(p) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def loss(x: np.ndarray, y: np.ndarray) -> float:
    """Of models that each saw half of the rows, on the other half."""
    half, out = np.arange(len(y)) % 2 == 0, 0.0
    for taught in (half, ~half):
        if len(set(y[taught])) < 2:
            return 0.0
        p = probability(x[~taught], fit(x[taught], y[taught]))
        out -= np.log(np.clip(np.where(y[~taught] > 0.5, p, 1 - p), 1e-6, 1)).sum()
    return float(out)


def site_weight(x: np.ndarray, y: np.ndarray, hosts: np.ndarray, paths: np.ndarray) -> float:
    """What a site's log-odds count beside the model's, from halves that judge each other; from 0 to 1."""
    half = np.arange(len(y)) % 2 == 0
    own, site = np.zeros(len(y)), np.zeros(len(y))
    for taught in (half, ~half):
        if len(set(y[taught])) < 2:
            return SITE_WEIGHT
        own[~taught] = logit(probability(x[~taught], fit(x[taught], y[taught])))
        prior = y[taught].mean()
        means = {}
        for level, above in ((hosts, None), (paths, hosts)):
            for g in np.unique(level):
                of = y[taught & (level == g)]
                up = prior if above is None else means[above[level == g][0]]
                means[g] = (of.sum() + FITTED * up) / (len(of) + FITTED)
        site[~taught] = [logit(means[g]) - logit(prior) for g in paths[~taught]]
    w = SITE_WEIGHT
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(own + w * site, -30, 30)))
        w = min(1.0, max(0.0, w - ((p - y) @ site + (w - SITE_WEIGHT)) / ((p * (1 - p)) @ site**2 + 1)))
    return float(w)


def train(docs: DataFrame, labels: DataFrame, *, ident: str, text: str, label: str, host: str, path: str, rows: int = TRAIN):
    """(words or None, model, weight of the site), from the labelled rows whose identifiers hash lowest: at most rows of them.

    None where no labelled document is found or all have one label. labels is (ident, label) without nulls or
    repeats.
    """
    some = labels.select(F.col(ident).alias("ql_id"), F.col(label).alias("ql_y")).orderBy(F.xxhash64(ident), ident).limit(rows)
    # At most rows identifiers and labels: 16 bytes each.
    found = docs.select(F.col(ident).cast("long").alias("ql_id"), F.col(host).alias("ql_host"), F.col(path).alias("ql_path"), F.col(text).alias("ql_text")).join(F.broadcast(some), "ql_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("ql_text")]
            x = [pa.array([f(t).tobytes() for t in texts], pa.binary()) for f in (lambda t: features(t).astype("<f4"), word_set)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ql_id", "ql_y", "ql_host", "ql_path")), *x], names=["i", "y", "host", "path", "x", "words"])

    # Which of them are taken is settled before any text is looked at.
    found = found.select("ql_id", "ql_y", "ql_host", "ql_path", "ql_text").mapInArrow(lean(run), "i long, y double, host string, path string, x binary, words binary")
    got = found.orderBy(F.xxhash64("i"), "i", "x").limit(rows).toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    if len(y) == 0 or y.min() == y.max():
        return None
    sets = [np.frombuffer(v.as_py(), "<u8") for v in got.column("words")]
    words = telling(sets, y)
    x = np.stack([np.frombuffer(v.as_py(), "<f4") for v in got.column("x")]).astype(float)
    if len(words):
        told = np.hstack([x[:, :LAYOUT], np.stack([np.isin(words, s) for s in sets])])
        x, words = (told, words) if loss(told, y) <= loss(x, y) else (x, None)
    else:
        words = None
    hosts, paths = (np.array(got.column(c).to_pylist()) for c in ("host", "path"))
    return words, fit(x, y), site_weight(x, y, hosts, np.char.add(np.char.add(hosts, "\n"), paths))


def _score(models: list, schema: list[str]):
    """Adds a probability for each model, 0.5 without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = batch.column("qc_text"), [np.full(batch.num_rows, 0.5) for _ in models]
            for at in range(0, batch.num_rows, 256):
                good = [k for k, model in enumerate(models) if model]
                for k, x in zip(good, described([t.as_py() for t in texts[at : at + 256]], [models[k][0] for k in good])):
                    scores[k][at : at + 256] = probability(x, models[k][1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema[: len(schema) - len(models)]), *map(pa.array, scores)], names=schema)

    return run


def strength(groups: DataFrame, prior: Column) -> float:
    """Prior strength of a level, by moments, from groups of (n, s, q): sums of 1, p and p squared."""
    row = groups.filter("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - prior, 2)).alias("between"),
        F.count(F.lit(1)).alias("g"),
    ).first()
    if not row["g"] or row["n"] <= row["g"]:
        return STRONG
    within = row["within"] / (row["n"] - row["g"])
    spread = max(0.0, (row["between"] - row["g"] * within) / row["n"])
    return float(min(STRONG, max(WEAK, within / spread if spread > 0 else STRONG)))


def _odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def sites(scored: DataFrame, known: DataFrame, score: str, scratch: Scratch, name: str) -> tuple[DataFrame, float]:
    """(qc_host, qc_path, host_mean, path_mean) by score, and the corpus mean. known is (qc_id, y)."""
    # Only keys and numbers are aggregated; a row's evidence is its label, or its score at a smaller weight.
    slim = scored.select(F.col("qc_id"), "qc_host", "qc_path", F.col(score).alias("p")).join(known, "qc_id", "left")
    weight, value = F.when(F.col("y").isNull(), SCORED).otherwise(1.0), F.coalesce("y", "p")
    sums = [F.sum(weight).alias("n"), F.sum(weight * value).alias("s"), F.sum(weight * value * value).alias("q")]
    paths = scratch.table(f"{name}_paths", slim.groupBy("qc_host", "qc_path").agg(*sums))
    hosts = paths.groupBy("qc_host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = whole["s"] / whole["n"] if whole["n"] else 0.5
    k = strength(hosts, F.lit(prior))
    hosts = hosts.select("qc_host", ((F.col("s") + k * prior) / (F.col("n") + k)).alias("host_mean"))
    paths = paths.join(hosts, "qc_host")
    k = strength(paths, F.col("host_mean"))
    return paths.select("qc_host", "qc_path", "host_mean", ((F.col("s") + k * F.col("host_mean")) / (F.col("n") + k)).alias("path_mean")), prior


def classify(docs: DataFrame, labels: DataFrame, *, ident: str = "doc_id", text: str = "text", label: str = "quality", toxic: str | None = "toxic", host: Column | None = None, path: Column | None = None, keep: list[str] | None = None, rows: int = TRAIN, threshold: float = 0.5, weight: float | None = None) -> DataFrame:
    """docs (or its columns keep) with doc_score, host_mean, path_mean, quality, toxic_score, toxic and kept.

    Columns of these names in docs are replaced, as are those that begin with qc_. kept is quality >= threshold
    and toxic < threshold. host defaults to column source and path to lang; a null host or path is a group of its
    own. Whole texts are scored, however long; null and empty text as such. Null identifiers and labels do not
    count; of repeated labels of a document the smallest does; repeated rows are scored alike and each count
    for their site. Without usable labels every document has 0.5 (quality) and 0 (toxic) and is kept. An empty
    table gives an empty table. weight sets the sites' weight, which else is fitted.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    added = ["doc_score", "host_mean", "path_mean", "quality", "toxic_score", "toxic", "kept", "qc_id", "qc_text", "qc_host", "qc_path"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in added]
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    keyed = docs.withColumns({"qc_id": F.col(ident).cast("long"), "qc_host": F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("")), "qc_path": F.coalesce(F.concat(F.lit("p"), path.cast("string")), F.lit("")), "qc_text": F.col(text).cast("string")})
    asked = {"doc_score": label} | ({"toxic_score": toxic} if toxic and toxic in labels.columns else {})
    known, models = {}, {}
    for score, name in asked.items():
        good = labels.filter(F.col(ident).isNotNull() & F.col(name).isNotNull())
        known[score] = scratch.table(f"{score}_labels", good.groupBy(F.col(ident).cast("long").alias("qc_id")).agg(F.min(F.col(name).cast("double")).alias("y")))
        models[score] = train(keyed, known[score], ident="qc_id", text="qc_text", label="y", host="qc_host", path="qc_path", rows=rows)
    names = [*columns, "qc_id", "qc_host", "qc_path"]
    made = lambda names: keyed.select(*names, "qc_text").mapInArrow(lean(_score(list(models.values()), [*names, *asked])), keyed.select(*names).withColumns({c: F.lit(0.0) for c in asked}).schema)
    # Sites are made of the scores, and rows get their sites' means after. Scores are written once; rows that go
    # on with their texts are scored again, which costs less than to write all texts.
    slim = names[len(columns) :]
    scored = scratch.table("scored", made(slim if text in columns else names))
    out = made(names) if text in columns else scored
    for score, (mean, result) in {"doc_score": ("host_mean", "quality"), "toxic_score": ("qc_mean", "toxic")}.items():
        if score not in asked:
            out = out.withColumns({"toxic_score": F.lit(0.0), "toxic": F.lit(0.0)})
            continue
        means, prior = sites(scored, known[score], score, scratch, score)
        w = (models[score][2] if models[score] else SITE_WEIGHT) if weight is None else weight
        out = out.join(means.withColumnsRenamed({"host_mean": mean, "path_mean": mean.replace("host", "path") if mean == "host_mean" else "qc_path_mean"}), ["qc_host", "qc_path"])
        below = F.col("path_mean" if score == "doc_score" else "qc_path_mean")
        p = 1 / (1 + F.exp(-(_odds(F.col(score)) + F.lit(w) * (_odds(below) - _odds(F.lit(prior))))))
        # Labels that are all alike teach nothing, neither of a text nor of a site.
        out = out.withColumn(result, p if models[score] else F.lit(0.5 if score == "doc_score" else 0.0))
    out = out.withColumn("kept", (F.col("quality") >= threshold) & (F.col("toxic") < threshold))
    return out.select(*columns, "doc_score", "host_mean", "path_mean", "quality", "toxic_score", "toxic", "kept")


def op4_quality_classifier(spark, sf_dir):
    """(doc_id, doc_score, host_mean, path_mean, quality, toxic_score, toxic, kept) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, keep=["doc_id"])
