"""Hand-computed fixtures and properties for operators without a SQL oracle."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.stats import norm_ppf, pnorm_col
from tallyframe.operators import abundance as A
from tallyframe.operators import community as U
from tallyframe.operators import denoise as D
from tallyframe.operators import distance as X
from tallyframe.operators import occupancy as O
from tallyframe.operators import scenario as M
from tallyframe.operators import taxonomy as T
from tallyframe.sources import io as S


def test_normal_quantiles_match_published_constants():
    assert norm_ppf(0.95) == pytest.approx(1.6448536269514715, abs=1e-12)
    assert norm_ppf(0.075) == pytest.approx(-1.4395314709384557, abs=1e-12)
    assert norm_ppf(0.03) == pytest.approx(-1.8807936081512509, abs=1e-12)
    assert norm_ppf(0.98) == pytest.approx(2.053748910631822, abs=1e-12)


def test_pnorm_column(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)], "x double")
    got = [r[0] for r in df.select(pnorm_col("x")).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in (-3.0, -1.0, 0.0, 0.5, 2.0)]
    assert np.allclose(got, want, atol=1e-7)


def test_ph_trend_sd():
    assert M.trend_sd(M.PH_TREND) == pytest.approx(0.0333603, abs=1e-7)


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "bottle string, a string, b string, bray double")


def test_centroid_distance_closed_form(spark):
    pairs = _pairs(spark, [("B1", "x1", "x2", 0.2), ("B1", "x1", "x3", 0.3), ("B1", "x2", "x3", 0.4),
                           ("B2", "y1", "y2", 0.5)])
    members = spark.createDataFrame([("B1", "x1"), ("B1", "x2"), ("B1", "x3"), ("B2", "y1"), ("B2", "y2")],
                                    "bottle string, sample string")
    got = {r["sample"]: r["distance"] for r in X.centroid_distance(pairs, members, "bottle").collect()}
    d = {("x1", "x2"): 0.2, ("x1", "x3"): 0.3, ("x2", "x3"): 0.4}
    dd = lambda i, j: 0.0 if i == j else d.get((i, j), d.get((j, i)))
    xs = ["x1", "x2", "x3"]
    tot = sum(dd(j, k) ** 2 for j in xs for k in xs)
    for i in xs:
        want = math.sqrt(abs(sum(dd(i, j) ** 2 for j in xs) / 3 - 0.5 * tot / 9))
        assert got[i] == pytest.approx(want, abs=1e-12)
    assert got["y1"] == pytest.approx(0.25) and got["y2"] == pytest.approx(0.25)


def test_spatial_median_two_and_equilateral(spark):
    pairs = _pairs(spark, [("B2", "y1", "y2", 0.5), ("B3", "z1", "z2", 0.6), ("B3", "z1", "z3", 0.6),
                           ("B3", "z2", "z3", 0.6)])
    got = {r["sample"]: r["distance"] for r in X.median_distance(pairs, "bottle").collect()}
    assert got["y1"] == pytest.approx(0.25, abs=1e-6)
    assert got["z1"] == pytest.approx(0.6 / math.sqrt(3), abs=1e-6)


def _brute_bray(tab):
    samples = sorted(tab)
    feats = sorted({f for s in tab for f in tab[s]})
    out = {}
    for i, a in enumerate(samples):
        for b in samples[i + 1:]:
            x = np.array([tab[a].get(f, 0.0) for f in feats])
            y = np.array([tab[b].get(f, 0.0) for f in feats])
            out[(a, b)] = 1 - 2 * np.minimum(x, y).sum() / (x.sum() + y.sum())
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_dissimilarity_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    tab = {f"s{i:02d}": {f"f{j}": float(rng.integers(1, 9)) for j in range(12) if rng.random() < 0.4}
           for i in range(14)}
    tab["lonely"] = {"fz": 3.0}
    rows = [(s, f, v) for s in tab for f, v in tab[s].items()]
    df = spark.createDataFrame(rows, "sample string, hash string, value double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in X.dissimilarity(df, blocks=blocks).collect()}
    want = _brute_bray(tab)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][0] == pytest.approx(v, abs=1e-12)
        assert got[k][1] == pytest.approx(2 * v / (1 + v), abs=1e-12)
        assert 0.0 <= got[k][0] <= 1.0


def test_edna_index_has_one_max_per_otu(spark):
    rows = [("a", "h1", 5), ("a", "h2", 5), ("b", "h1", 1), ("b", "h3", 9), ("c", "h2", 2)]
    df = spark.createDataFrame(rows, "sample string, hash string, n_reads long")
    idx = A.edna_index(df).collect()
    assert all(0 < r["index"] <= 1 for r in idx)
    by = {}
    for r in idx:
        by.setdefault(r["hash"], []).append(r["index"])
    assert all(max(v) == pytest.approx(1.0) for v in by.values())


def test_subtraction_never_negative(spark):
    smp = spark.createDataFrame([(1, "s1", "h1", 10), (1, "s1", "h2", 1), (1, "s2", "h1", 3)],
                                "run int, sample string, hash string, n_reads long")
    vec = spark.createDataFrame([(1, "h1", 0.5), (1, "h2", 0.01)], "run int, hash string, vector_contamination double")
    out = {(r["sample"], r["hash"]): r["n_reads"] for r in D.subtract_contamination(smp, vec).collect()}
    # s1 total 11: h1 10 - ceil(5.5) = 4; h2 1 - ceil(0.11) = 0 -> dropped; s2: 3 - ceil(1.5) = 1
    assert out == {("s1", "h1"): 4, ("s2", "h1"): 1}


def test_sequential_join_levels(spark):
    df1 = spark.createDataFrame([("x1", "sp1", "g1"), ("x2", "spX", "g1"), ("x3", "spY", "g2"), ("x4", "spZ", "g9")],
                                "hash string, species string, genus string")
    df2 = spark.createDataFrame([("sp1", "g1", "A"), ("sp2", "g1", "A"), ("sp3", "g2", "A"), ("sp4", "g2", "B")],
                                "species string, genus string, trait string")
    got = {r["hash"]: (r["trait"], r["confidence"]) for r in
           T.sequential_join(df1, df2, ["species", "genus"], ["trait"]).collect()}
    assert got == {"x1": ("A", "species"), "x2": ("A", "genus"), "x3": ("undetermined", "genus"),
                   "x4": (None, None)}


def test_translation_code5(spark):
    # offset 2: first base skipped; TGA codes W under code 5, TAA/TAG stop
    df = spark.createDataFrame([("a", "GATGTGGTTT"), ("b", "GTAAATGCCC")], "hash string, sequence string")
    got = {r["hash"]: r["aa"] for r in df.withColumn("aa", T.translate("sequence", 2)).collect()}
    assert got == {"a": "MWF", "b": "*MP"}
    kept = [r["hash"] for r in T.translate_filter(df).collect()]
    assert kept == ["a"]


def test_occupancy_order(spark):
    pats = spark.createDataFrame([("10.0.0.0", 10, 0, 0, 0), ("7.1.1.1", 7, 1, 1, 1), ("0.0.0.10", 0, 0, 0, 10)],
                                 "pattern string, n0 long, n1 long, n2 long, n3 long")
    fit = O.occupancy_fit(pats, 3, 12).join(pats.select("pattern", O.max_detections(3).alias("x")), "pattern")
    prob = {r["pattern"]: r["p"] for r in
            fit.select("pattern", O.prob_occupancy("x", "psi", "p11", "p10").alias("p")).collect()}
    assert prob["10.0.0.0"] < prob["7.1.1.1"] < prob["0.0.0.10"]


def test_standardize_mean_zero_sd_one(spark):
    rows = [("A", float(v)) for v in (1, 2, 3, 10)] + [("B", 5.0), ("B", 5.0)]
    df = spark.createDataFrame(rows, "area string, x double")
    out = M.standardize_by(df, ["x"], "area").collect()
    a = np.array([r["x_std"] for r in out if r["area"] == "A"])
    assert a.mean() == pytest.approx(0.0, abs=1e-12) and a.std(ddof=1) == pytest.approx(1.0)
    assert [r["x_std"] for r in out if r["area"] == "B"] == [5.0, 5.0]  # constants kept


def test_permanova_sums_and_brute_force(spark):
    rng = np.random.default_rng(2)
    names = [f"e{i}" for i in range(9)]
    groups = {n: "g1" if i < 4 else "g2" for i, n in enumerate(names)}
    rows, D2 = [], {}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            d = float(rng.uniform(0.1, 1.0))
            rows.append((a, b, d))
            D2[(a, b)] = d * d
    pairs = spark.createDataFrame(rows, "sample1 string, sample2 string, bray double")
    g = spark.createDataFrame(list(groups.items()), "sample string, group string")
    r = U.permanova(pairs, g).first()
    n = len(names)
    sst = sum(D2.values()) / n
    ssw = sum(sum(v for (a, b), v in D2.items() if groups[a] == groups[b] == k) / sum(1 for x in groups.values() if x == k)
              for k in ("g1", "g2"))
    assert r["ss_total"] == pytest.approx(sst) and r["ss_within"] == pytest.approx(ssw)
    assert r["ss_total"] == pytest.approx(r["ss_within"] + r["ss_between"])
    assert r["F"] == pytest.approx(((sst - ssw) / 1) / (ssw / (n - 2)))
    p = U.permanova_test(pairs, g, nperm=49, seed=3).first()
    assert 0 < p["p"] <= 1 and p["nperm"] == 49


def test_permutation_sums_of_many_permutations_match_single_rows(spark):
    rng = np.random.default_rng(4)
    names = [f"s{i}" for i in range(9)]
    rows = [(a, b, float(rng.uniform(0.1, 1))) for i, a in enumerate(names) for b in names[i + 1:]]
    pairs = spark.createDataFrame(rows, "a string, b string, d double")
    lab = spark.createDataFrame([(x, "xyz"[i % 3] if i else "x") for i, x in enumerate(names)], "s string, g string")
    got = {r["perm"]: r["ss_within"] for r in U._ss_within_permuted(pairs, lab, 300, 3).collect()}
    perm = {}
    for r in U.permuted_labels(lab, 300, 3).collect():
        perm.setdefault(r["perm"], {})[r["s"]] = r["g"]
    assert sorted(got) == sorted(perm) == list(range(1, 301))
    for k, g in perm.items():
        n = list(g.values())
        assert got[k] == pytest.approx(sum(d * d / n.count(g[a]) for a, b, d in rows if g[a] == g[b]))


def test_registered_permutations_are_the_references(spark):
    from unittest import mock
    from tallyframe.plans import q_community as Q
    with mock.patch.multiple(Q.U, permanova_test=mock.DEFAULT, ordination_test=mock.DEFAULT, simper_permutation_p=mock.DEFAULT,
                             kmeans_clusters=mock.MagicMock(return_value=(mock.MagicMock(), 0.0))) as m, \
            mock.patch.multiple(Q, event_pairs=mock.DEFAULT, event_groups=mock.DEFAULT, event_env=mock.DEFAULT,
                                event_table=mock.DEFAULT, event_clusters=mock.DEFAULT), mock.patch.object(Q.V, "table"):
        Q.u9p(None, ""), Q.u11(None, ""), Q.u16(None, ""), Q.u12(None, "")
        assert m["permanova_test"].call_args.kwargs["nperm"] == 9999
        assert m["ordination_test"].call_args.kwargs["nperm"] == 999
        assert m["simper_permutation_p"].call_args.kwargs["nperm"] == 999
        assert Q.U.kmeans_clusters.call_args.kwargs["restarts"] == 15


def test_rank_sum_against_direct_formula(spark):
    x = [1.0, 2.0, 2.0, 5.0, 7.0]
    y = [2.0, 3.0, 4.0, 8.0, 9.0, 9.0]
    rows = [("k", "a", v) for v in x] + [("k", "b", v) for v in y]
    df = spark.createDataFrame(rows, "key string, grp string, v double")
    r = M.rank_sum_test(df, "key", "grp", "v", "a", "b").first()
    allv = sorted(x + y)
    rank = {v: np.mean([i + 1 for i, w in enumerate(allv) if w == v]) for v in set(allv)}
    W = sum(rank[v] for v in x) - len(x) * (len(x) + 1) / 2
    assert r["W"] == pytest.approx(W)
    assert 0 < r["p"] <= 1


def test_contains_any_word_ngrams(spark):
    df = spark.createDataFrame([("k1", "Animalia;Brand#3;small ring"), ("k2", "tired ring;x")], "key string, txt string")
    terms = spark.createDataFrame([("small ring",), ("red ring",), ("x",)], "term string")
    got = sorted((r["key"], r["term"]) for r in T.contains_any(df, "key", "txt", terms).collect())
    assert got == [("k1", "small ring"), ("k2", "x")]


def test_contains_substring_inside_words_and_across_separators(spark):
    df = spark.createDataFrame([("k1", "Animalia;Brand#3;small ring"), ("k2", "tired ring;x"), ("k3", None), ("k4", "")],
                               "key string, txt string")
    terms = spark.createDataFrame([("small ring",), ("red ring",), ("x",), ("ring;x",), ("al",), ("no ring",), (" ",), (None,)],
                                  "term string")
    got = sorted((r["key"], r["term"]) for r in T.contains_substring(df, "key", "txt", terms).collect())
    assert got == [("k1", "al"), ("k1", "small ring"), ("k2", "red ring"), ("k2", "ring;x"), ("k2", "x")]


def test_contains_substring_query_matches_its_sql(spark):
    import __spark_entry__ as E
    from oracle_check import compare, duck
    d = "/root/testdata/sf0.001"
    ok, msg = compare(E.queries()["t10_contains_substring"](spark, d), duck(d), E.oracle_sql()["t10_contains_substring"])
    assert ok, msg


def test_sources_roundtrip(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "runs")
    for run, body in (("Run_1_2017", "sample,Hash,nReads\nA_1.1,h1,5\n"), ("Run_3_2018", "sample,Hash,nReads\nB_1.1,h2,NA\n")):
        os.makedirs(os.path.join(root, run))
        with open(os.path.join(root, run, "ASV_table.csv"), "w") as f:
            f.write(body)
        with open(os.path.join(root, run, "other.csv"), "w") as f:
            f.write("x\n1\n")
    df = S.read_runs(spark, root, "ASV_table.csv", schema="sample string, Hash string, nReads long")
    got = sorted((r["run"], r["sample"], r["nReads"]) for r in df.collect())
    assert got == [(1, "A_1.1", 5), (3, "B_1.1", None)]
    p1, p2 = os.path.join(tmpdir_path, "m1.csv"), os.path.join(tmpdir_path, "m2.csv")
    open(p1, "w").write("sample_id,Tag,extra\ns1,Tag_1,z\n")
    open(p2, "w").write("Tag,sample_id\nTag_12,s2\n")
    u = S.read_union(spark, [p1, p2], ["sample_id", "Tag", "pri_index_name"])
    assert sorted((r["sample_id"], r["Tag"], r["pri_index_name"]) for r in u.collect()) == \
        [("s1", "Tag_1", None), ("s2", "Tag_12", None)]
    p3 = os.path.join(tmpdir_path, "t.tsv")
    open(p3, "w").write("ID1=a;ID2A=b\tACGT\t  12\n")
    t = S.read_table(spark, p3, "keys string, barcode string, n long", sep="\t", header=False)
    assert t.first()["n"] == 12
    fasta = os.path.join(tmpdir_path, "out.fasta")
    S.write_fasta(spark.createDataFrame([("h1", "ACGT")], "hash string, sequence string"), fasta)
    text = "".join(open(os.path.join(fasta, f)).read() for f in os.listdir(fasta) if f.startswith("part"))
    assert text == ">h1\nACGT\n"
    ck = S.stage_checkpoint(df, os.path.join(tmpdir_path, "ck"))
    assert ck.count() == 2


def test_constrained_ordination_matches_dense_algebra(spark):
    rng = np.random.default_rng(7)
    n, names = 12, [f"s{i:02d}" for i in range(12)]
    pts = rng.normal(size=(n, 4))
    Dm = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    rows = [(names[i], names[j], float(Dm[i, j])) for i in range(n) for j in range(i + 1, n)]
    pairs = spark.createDataFrame(rows, "sample1 string, sample2 string, bray double")
    env = rng.normal(size=(n, 2))
    envdf = spark.createDataFrame([(names[i], float(env[i, 0]), float(env[i, 1])) for i in range(n)],
                                  "sample string, t double, p double")
    eig, scores, _ = U.constrained_ordination(pairs, envdf, ["t", "p"])
    lam = sorted((r["eigenvalue"] for r in eig.collect()), reverse=True)
    J = np.eye(n) - 1.0 / n
    G = -0.5 * J @ (Dm ** 2) @ J
    Z = (env - env.mean(0)) / env.std(0, ddof=1)
    H = Z @ np.linalg.inv(Z.T @ Z) @ Z.T
    want = sorted(np.linalg.eigvalsh(H @ G @ H), reverse=True)[:2]
    assert np.allclose(lam, want, atol=1e-9)
    t = U.ordination_test(pairs, envdf, ["t", "p"], nperm=19, seed=1).first()
    assert t["constrained"] == pytest.approx(sum(want), rel=1e-9) and 0 < t["p"] <= 1


def test_incremental_stream_classifies_each_key_once(spark, tmpdir_path):
    from tallyframe.streaming.incremental import classify_new_keys
    src, res, ck = (os.path.join(tmpdir_path, x) for x in ("src", "res", "ck"))
    cls = spark.createDataFrame([("h1", "F1"), ("h2", "F2"), ("h3", "F3")], "hash string, family string")
    spark.createDataFrame([("h1",), ("h2",)], "hash string").write.parquet(os.path.join(src, "b1"))
    q = classify_new_keys(spark, src + "/*", "hash string", cls, res, ck)
    q.awaitTermination()
    spark.createDataFrame([("h2",), ("h3",)], "hash string").write.parquet(os.path.join(src, "b2"))
    q = classify_new_keys(spark, src + "/*", "hash string", cls, res, ck)
    q.awaitTermination()
    got = sorted((r["hash"], r["family"]) for r in spark.read.parquet(res).collect())
    assert got == [("h1", "F1"), ("h2", "F2"), ("h3", "F3")]


def test_stream_state_survives_repeated_epochs_and_previous_results(spark, tmpdir_path):
    from tallyframe.streaming.incremental import classify_new_keys
    src, res, ck = (os.path.join(tmpdir_path, x) for x in ("src", "res", "ck"))
    cls = spark.createDataFrame([("h1", "F1"), ("h2", "F2")], "hash string, family string")
    old = spark.createDataFrame([("h0", "F0")], "hash string, family string")

    def arrive(name, keys):
        spark.createDataFrame([(k,) for k in keys], "hash string").write.parquet(os.path.join(src, name))
        classify_new_keys(spark, src + "/*", "hash string", cls, res, ck, previous=old).awaitTermination()
        return sorted(((r["hash"], r["family"]) for r in spark.read.parquet(res).collect()), key=str)

    assert arrive("b1", ["h1", "h1", "h0"]) == [("h1", "F1")]
    want = [("h1", "F1"), ("h2", "F2"), ("h3", None), (None, None)]
    assert sorted(arrive("b2", ["h2", "h3", None, None, "h1"]), key=str) == sorted(want, key=str)
    # the last epoch runs again, as after a failure between its output and its commit
    commits = os.path.join(ck, "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    assert sorted(arrive("b3", ["h3", "h2"]), key=str) == sorted(want, key=str)
    for i in range(3):  # batches of known keys only
        arrive(f"c{i}", ["h1", "h2"])
    assert sorted(arrive("d", ["h4"]), key=str) == sorted([*want, ("h4", None)], key=str)


def test_union_of_many_headers(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "many")
    os.makedirs(d)
    files = {"a.csv": "\n\nx,y,z\n1,2,3\n4,NA\n", "b.csv": 'z,"q,r",x\n9,"8,8",7\n', "c.csv": "\ufeffx\n5\n", "d.csv": "",
             "e.csv": "y,x,x\n", "f.csv": "k\n1\n"}
    for name, text in files.items():
        open(os.path.join(d, name), "w").write(text)
    for i in range(40):
        open(os.path.join(d, f"m{i:02d}.csv"), "w").write("w," * (i % 5) + "x,y\n" + "0," * (i % 5) + f"x{i},y{i}\n")
    got = {}
    for r in S.read_union(spark, d, ["x", "y", "q,r"]).collect():
        got.setdefault(os.path.basename(r["source_file"]), []).append((r["x"], r["y"], r["q,r"]))
    assert sorted(got.pop("a.csv")) == [("1", "2", None), ("4", None, None)]
    assert got.pop("b.csv") == [("7", None, "8,8")] and got.pop("c.csv") == [("5", None, None)]
    assert got.pop("f.csv") == [(None, None, None)]
    assert got == {f"m{i:02d}.csv": [(f"x{i}", f"y{i}", None)] for i in range(40)}
    assert S.read_union(spark, os.path.join(d, "d.csv"), ["x"]).count() == 0


def test_prefix_sum_spans_partitions(spark):
    from tallyframe.operators._util import prefix_sum
    rows = [("k", float(i), 1) for i in range(100)] + [("j", float(i), 2) for i in range(10)]
    df = spark.createDataFrame(rows, "key string, v double, c long")
    got = {(r["key"], r["v"]): r["p"] for r in prefix_sum(df, "key", ["v"], "c", "p", partitions=6).collect()}
    assert all(got[("k", float(i))] == i for i in range(100))
    assert all(got[("j", float(i))] == 2 * i for i in range(10))


def test_bernoulli_draws_agree_with_mean(spark):
    rows = [(f"t{i}", "A", 0.1 * (i % 10)) for i in range(30)]
    df = spark.createDataFrame(rows, "taxon string, area string, p double")
    mean = {r["taxon"]: r["mean_presence"] for r in M.bernoulli_mean(df, "p", ["taxon", "area"], n=50, seed=3).collect()}
    draws = M.bernoulli_draws(df, "p", ["taxon", "area"], n=50, seed=3)
    got = {r["taxon"]: r["m"] for r in draws.groupBy("taxon").agg(F.avg("present").alias("m")).collect()}
    assert got == pytest.approx(mean)
    assert mean["t0"] == 0.0


def test_prefix_sum_across_arrow_batches(spark):
    from tallyframe.operators._util import prefix_sum
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("k", float(i), 1) for i in range(60)] + [("j", float(i), 3) for i in range(25)]
        df = spark.createDataFrame(rows, "key string, v double, c long")
        got = {(r["key"], r["v"]): r["p"] for r in prefix_sum(df, "key", ["v"], "c", "p", partitions=2).collect()}
        assert all(got[("k", float(i))] == i for i in range(60))
        assert all(got[("j", float(i))] == 3 * i for i in range(25))
        nokey = {r["v"]: r["p"] for r in prefix_sum(df.where("key = 'k'"), [], ["v"], "c", "p", partitions=3).collect()}
        assert all(nokey[float(i)] == i for i in range(60))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_per_row_index_sums_run_shares(spark):
    # sample a: h1 in two runs (4 and 6 reads), h2 10 reads -> total 20
    rows = [(1, "a", "h1", 4), (2, "a", "h1", 6), (1, "a", "h2", 10), (1, "b", "h1", 5), (1, "b", "h2", 5)]
    df = spark.createDataFrame(rows, "run int, sample string, hash string, n_reads long")
    got = {(r["sample"], r["hash"]): r["value"] for r in A.edna_index(df, out="value", per_row=True).collect()}
    # row shares: a/h1 0.2 and 0.3, a/h2 0.5, b/h1 0.5, b/h2 0.5; maxima h1 0.5, h2 0.5
    assert got[("a", "h1")] == pytest.approx(0.2 / 0.5 + 0.3 / 0.5)
    assert got[("a", "h2")] == pytest.approx(1.0) and got[("b", "h1")] == pytest.approx(1.0)


def test_coverage_report_wide_and_order(spark):
    import datetime as dt
    reads = spark.createDataFrame([("AA_199501A.1", "h", 10), ("AA_199501A.2", "h", 20), ("BB_199601A.1", "h", 7)],
                                  "sample string, hash string, n_reads long")
    cov = spark.createDataFrame([("AA_1995", "AA", dt.date(1995, 1, 1), "X", 2), ("BB_1996", "BB", dt.date(1996, 1, 1), "X", 1)],
                                "event string, site string, date date, area string, cases long")
    # events are the sample ids without their last three characters
    reads = reads.withColumn("sample", F.regexp_replace("sample", "01A", "A"))
    w = D.coverage_report(reads, cov, wide=True, site_order=["BB", "AA"]).collect()
    assert [r["site"] for r in w] == ["BB", "AA"]
    aa = [r for r in w if r["site"] == "AA"][0]
    assert aa["Jan'1995"] == "2 (15 +- 7)" and aa["Jan'1996"] == ""


def test_lineage_wide_relabel(spark):
    rows = [("k1", "family", "F1"), ("k1", "genus", "G1"), ("k1", "no rank", "cellular")]
    df = spark.createDataFrame(rows, "key string, rank string, name string")
    r = T.lineage_wide(df, ranks=["family", "genus"], relabel={"family": "Family"}).first()
    assert r["Family"] == "F1" and r["genus"] == "G1"


@pytest.mark.parametrize("band_rows", [10, 100000])
def test_hodges_lehmann_exact(spark, band_rows):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(5, 2, 40), 1)
    y = np.round(rng.normal(4, 2, 37), 1)
    rows = [("k", "a", float(v)) for v in x] + [("k", "b", float(v)) for v in y]
    df = spark.createDataFrame(rows, "key string, grp string, v double")
    got = M.hodges_lehmann(df, "key", "grp", "v", "a", "b", band_rows=band_rows).first()["hl"]
    assert got == pytest.approx(float(np.median(np.subtract.outer(x, y).ravel())), abs=1e-9)


def test_occupancy_medians_settle_and_follow_long_runs_of_bottles():
    n = np.array([[10, 0, 0, 0], [7, 1, 1, 1], [0, 0, 0, 10], [70000, 200, 9000, 20800], [0, 0, 0, 0]], float)
    a, b = (O._posterior_medians(n, g, 50.0, 0.01, 4) for g in (20, 40))
    assert np.abs(a - b).max() < 2e-3
    # without bottles the priors' medians come back
    assert np.allclose(b[4], [0.5, 0.505, 1 - 0.5 ** (1 / 50)], atol=2e-3)
    # many bottles: psi, p11 and p10 are those that made the pattern (p11 = 0.87, psi = 0.31)
    psi, p11 = b[3, :2]
    assert abs(psi - 0.3) < 0.01 and abs(p11 - (200 + 2 * 9000 + 3 * 20800) / 3 / 30000) < 0.01
