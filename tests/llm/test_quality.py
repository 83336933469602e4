import numpy as np

from tidemark.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    taught, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = quality.classify(docs, taught).selectExpr("doc_id", "quality >= 0.5 AS good", "toxic >= 0.5 AS bad").join(held, "doc_id").collect()
    assert len(got) > 150 and np.mean([x.good == (x.quality == 1) for x in got]) >= 0.97
    toxic = [x.bad for x in got if x.toxic == 1]
    # 16 toxic documents are taught here; most of what they foretell is words in one of four languages.
    assert len(toxic) > 10 and np.mean(toxic) >= 0.5 and np.mean([x.bad for x in got if x.toxic == 0]) <= 0.01


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "fine words here and there", "a", "en", 1.0), (1, "fine words here and there", "a", "en", 1.0), (2, None, None, None, 2.0), (None, "", "b", None, 3.0), (4, "!!! $$$ ### " * 50, "b", "en", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality double")
    labels = spark.createDataFrame([(1, 1, "x"), (4, 0, "y"), (None, 1, "z"), (2, None, "w")], "doc_id long, quality int, n string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and {x.doc_id: x.kept for x in got}[4] is False and all(0 < x.quality < 1 for x in got)
    assert [x.doc_score for x in got if x.doc_id == 1][0] == [x.doc_score for x in got if x.doc_id == 1][1]
    assert set(quality.classify(docs, labels.filter("doc_id = 9")).select("kept", "quality", "toxic").distinct().collect()) == {(True, 0.5, 0.0)}
    assert quality.classify(docs.filter("doc_id = 9"), labels).count() == 0


def test_sparse_sites_shrink_to_the_level_above(spark):
    groups = spark.createDataFrame([(100, 90.0, 85.0), (100, 10.0, 5.0)], "n long, s double, q double")
    from pyspark.sql import functions as F

    assert quality.strength(groups, F.lit(0.5)) == quality.WEAK
    alike = spark.createDataFrame([(100, 50.0, 50.0), (100, 50.0, 50.0)], "n long, s double, q double")
    assert quality.strength(alike, F.lit(0.5)) == quality.STRONG


def test_levels_against_plain_python(spark, sf):
    """Posteriors and their combination, recounted from the scores and labels."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, keep=["doc_id", "source", "lang"], weight=0.7).collect()
    assert len(rows) == docs.count()
    odds = lambda p: float(quality.logit(p))

    def level(groups, above):
        """Posterior means of groups {key: [(weight, value)]}; above gives the mean that a key shrinks to."""
        sums = {k: (sum(w for w, _ in v), sum(w * x for w, x in v), sum(w * x * x for w, x in v)) for k, v in groups.items()}
        some = {k: v for k, v in sums.items() if v[0] > 1}
        n, g = sum(v[0] for v in some.values()), len(some)
        k = quality.STRONG
        if g and n > g:
            within = sum(q - s * s / m for m, s, q in some.values()) / (n - g)
            between = sum(m * (s / m - above(key)) ** 2 for key, (m, s, _) in some.items())
            spread = max(0.0, (between - g * within) / n)
            k = min(quality.STRONG, max(quality.WEAK, within / spread if spread > 0 else quality.STRONG))
        return {key: (s + k * above(key)) / (m + k) for key, (m, s, _) in sums.items()}

    for name, score, result in (("quality", "doc_score", "quality"), ("toxic", "toxic_score", "toxic")):
        y = {x.doc_id: float(x[name]) for x in labels.collect() if x[name] is not None}
        evidence = [((x.source, x.lang), (1.0, y[x.doc_id]) if x.doc_id in y else (quality.SCORED, x[score])) for x in rows]
        prior = sum(w * v for _, (w, v) in evidence) / sum(w for _, (w, _) in evidence)
        hosts, paths = {}, {}
        for (h, p), e in evidence:
            hosts.setdefault(h, []).append(e)
            paths.setdefault((h, p), []).append(e)
        hosts = level(hosts, lambda k: prior)
        paths = level(paths, lambda k: hosts[k[0]])
        for x in rows:
            want = 1 / (1 + np.exp(-(odds(x[score]) + 0.7 * (odds(paths[x.source, x.lang]) - odds(prior)))))
            assert abs(x[result] - want) < 1e-9
            if name == "quality":
                assert abs(x.host_mean - hosts[x.source]) < 1e-9 and abs(x.path_mean - paths[x.source, x.lang]) < 1e-9
    assert all(x.kept == (x.quality >= 0.5 and x.toxic < 0.5) for x in rows)


def test_labels_of_a_site_reach_its_unlabelled_documents(spark):
    """Texts say nothing; hosts differ by their labels alone."""
    rows = [(k, "same words in all", "good" if k % 2 else "bad", "p") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(docs, labels, keep=["doc_id"]).collect()}
    assert all(got[k].kept == (k % 2 == 1) and got[k].toxic == 0 for k in range(400))


def test_very_long_and_tied_texts(spark):
    docs = spark.createDataFrame([(1, "fine words " * 100000, "a", "en"), (2, "fine words", "a", "en"), (3, "fine words", "a", "en"), (4, "?!#", "a", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(2, 1), (4, 0), (2, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    assert len(got) == 4 and got[2].quality == got[3].quality and 0 < got[1].quality < 1
