"""Operators for training data against brute force on small tables, edge cases included."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import (_text, chat, decontaminate, extract, gru, license_rules, licenses, lm_scores, mixing, neardup, quality,
                            sharding, token_files)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def sentence(seed, n=80):
    g = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in g.integers(0, 26, 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(sentence(s, 400) for s in range(20))
    near = sentence(1).split()
    rows = [(1, sentence(1)), (2, sentence(1)), (3, " ".join(near[:-1] + ["other"])), (4, sentence(2)), (5, None), (6, ""), (7, " \n\t "),
            (None, sentence(3)), (8, "one"), (9, "ONE"), (10, long), (10, long), (11, "É É É " * 60), (12, sentence(4) + "\n" + sentence(4)),
            (13, "MIT License and the GNU General Public License. CC-BY! apache license"), (14, sentence(5) + " <|endoftext|> 's don't x.")]
    return spark.createDataFrame([(i, x, "en", None if i == 4 else f"s{(i or 0) % 3}", 0) for i, x in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def wide(df):
    """Extra columns that clash with names the operators use."""
    names = ["size", "target", "taken", "n_words", "kept", "cls", "n", "regs", "items", "labels", "slot", "th", "id", "row", "h"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def test_license_scan(spark, docs, none):
    got = {r.doc_id: r for r in licenses.scan_licenses(wide(docs)).collect()}
    r = got[13]
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (12, 4, 0, 10)
    assert r.base_labels == "apache,cc-by,gpl,mit" and 0 < r.score <= 1
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, 0, None, "", 0)
    assert licenses.scan_licenses(none).count() == 0
    # every rule against a plain loop over texts made to match it, with suppression
    texts = ["licensed under the terms of the GNU Lesser General Public License version 2.1", "SPDX-License-Identifier: MIT",
             "see the Apache License, Version 2.0", "mit license mit license", "cc by sa 4.0", "xmit license", "released into the public domain"]
    rules = license_rules.rules()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in licenses.scan_licenses(df).collect():
        norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(texts[row.doc_id]))) + " "
        hits = sorted((norm[:m.start()].count(" "), -(norm[:m.end()].count(" ")), -prio, no, label)
                      for no, (label, prio, _, _, rx, _) in enumerate(rules) for m in re.finditer(rx, norm))
        left = [h for i, h in enumerate(hits) if not any(g[0] <= h[0] and g[1] <= h[1] and g[2] <= h[2] for g in hits[:i])]
        base = {h[4] for h in hits if rules[h[3]][5]}
        assert row.labels == ",".join(sorted({h[4] for h in left} | base)), texts[row.doc_id]
        assert row.detections == len(left)


def test_license_keywords_are_in_their_matches():
    marks = licenses.anchors(license_rules.rules())
    assert all(any(a in key or a in rx for a in marks) for _, _, _, key, rx, _ in license_rules.rules())


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(wide(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 0.5
        assert rows[0].source_size == sum(r["size"] for r in rows)
    total = sum(r["size"] for r in got)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert sorted(map(str, mixing.mix_sources(docs.repartition(7)).select("doc_id", "size", "taken").collect())) == \
        sorted(map(str, mixing.mix_sources(docs).select("doc_id", "size", "taken").collect()))
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(wide(docs)).columns == wide(docs).columns


def test_quality(docs, none):
    for r in quality.quality(docs).collect():
        w = WORDS.findall(r.text or "")
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == \
            (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.filter_quality(wide(docs)).collect()}
    assert {1, 2, 3, 4, 10} <= kept and not kept & {5, 6, 7, 8, 11, 12}
    assert quality.quality(none).count() == 0


def test_simple8b_round_trip():
    g = np.random.default_rng(3)
    for n in (0, 1, 59, 60, 61, 5000):
        v = (g.integers(0, 2**63, n, dtype=np.uint64) >> g.integers(0, 63, n).astype(np.uint64)) * np.uint64(2)
        assert (token_files.decode_block(token_files.encode_block(v), n) == v).all()


def test_token_files(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, at, want = Tokenizer.from_file(path), 0, []
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, x in rows:
        ids = tok.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.token_files(wide(docs), path).collect()), key=lambda r: r[1]) == want
    assert token_files.token_files(none, path).count() == 0


def test_language_model(docs, none):
    got = lm_scores.lm_scores(docs).collect()
    toks = [(r.doc_id, zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 == 2, WORDS.findall(fold(r.text)) + [None])
            for r in docs.collect()]
    c = Counter(w for _, held, t in toks if not held for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held, len(t), sum(c[w] > 0 for w in t), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, held, t in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and np.isfinite(r.score) and r.train_tokens == n for r in got)
    assert lm_scores.lm_scores(none).count() == 0


def test_common_words_have_ids_of_their_own():
    h = np.append(lm_scores.END_HASH, np.arange(2, 4096, dtype=np.uint64))
    v = lm_scores.Vocabulary(h, np.arange(len(h), 0, -1))
    assert v.id.tolist() == [*range(1, 4096), gru.UNKNOWN]
    assert gru.DIM >= 16 and gru.HIDDEN >= 16


def test_recurrent_model_gradient_and_lanes():
    g = np.random.default_rng(0)
    ids, bounds = g.integers(0, gru.VOCAB, 300), np.array([0, 9, 10, 200, 300])
    p = gru.start(np.bincount(ids, minlength=gru.VOCAB))
    alone = [gru.log10_probs(p, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(bounds[:-1], bounds[1:])]
    assert np.allclose(gru.log10_probs(p, ids, bounds), alone, rtol=1e-5)
    hs = g.standard_normal((50, gru.HIDDEN)).astype(np.float32) * 0.3
    _, dh, grads = gru._output(p, hs, ids[:50], True)
    for k, at in (("wc", (3, 4)), ("bo", (int(ids[0]) // gru.WIDTH, 5))):
        q = {x: y.astype(np.float64) for x, y in p.items()}
        up, down = {**q, k: q[k].copy()}, {**q, k: q[k].copy()}
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        f = lambda w: -gru._output({x: y.astype(np.float32) for x, y in w.items()}, hs, ids[:50], False)[0].astype(np.float64).sum()
        assert grads[k][at] == pytest.approx((f(up) - f(down)) / 2e-2, abs=2e-2, rel=2e-2)
    t = gru.Trainer(p)
    before = gru.log10_probs(p, ids, bounds).sum()
    for _ in range(20):
        t.learn(ids, bounds)
    assert gru.log10_probs(t.p, ids, bounds).sum() > before


def test_shards(docs, none):
    names = sharding.shard_names(7)
    table = sharding.claim_table(names, 211)
    count = Counter(table)
    assert set(table) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    fewer = sharding.claim_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 211 / 4
    got = sharding.assign_shards(wide(docs), "doc_id", names, 211).collect()
    assert all(r.shard == names[table[r.slot]] for r in got) and len(got) == docs.count()
    assert sharding.assign_shards(none, "doc_id", names, 211).count() == 0
    with pytest.raises(ValueError):
        sharding.claim_table(names, 210)


def edits_to_part(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (w != x)))
        row = new
    return min(row)


def test_decontamination(spark, none):
    g = np.random.default_rng(5)
    items = [(i, sentence(100 + i, int(g.integers(3, 40)))) for i in range(12)] + [(50, None), (51, "")]
    rows = []
    for k in range(80):
        w = items[k % 12][1].split()
        for _ in range(int(g.integers(0, max(1, len(w) // 3)))):
            p = int(g.integers(0, len(w)))
            w[p:p + 1] = [[], ["zzz"], [w[p], "new"]][int(g.integers(0, 3))]
            if not w:
                break
        rows.append((k, sentence(1000 + k, 50) + " " + " ".join(w).upper() + ". " + sentence(2000 + k, 50)))
    rows += [(900, None), (901, ""), (None, items[3][1])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.contamination(d, b).collect()}
    missed = 0
    for k, x in rows:
        text = re.findall(r"[0-9a-z]+", (x or "").lower())
        want = [i for i, y in items if y and edits_to_part(y.split(), text) <= int(0.2 * len(y.split()) + 1e-9)]
        assert set(got[k]) <= set(want)
        missed += len(want) - len(got[k])
    assert missed <= 1
    assert decontaminate.drop_contaminated(none, b).count() == 0
    assert decontaminate.contamination(d, b.where("false")).where("contaminated").count() == 0


def test_decontamination_finds_long_items_at_the_edit_limit():
    g = np.random.default_rng(11)
    items, texts, want = [], [], []
    for m in (60, 100, 160, 200, 400):
        w = sentence(3000 + m, m).split()
        items.append(" ".join(w))
        for kind in ("delete", "insert", "mixed"):
            for _ in range(8):
                run, left = list(w), int(0.2 * m)
                for p in sorted(g.choice(m, left, replace=False), reverse=True):
                    how = int(g.integers(0, 3)) if kind == "mixed" else ("delete", "insert").index(kind)
                    run[p:p + 1] = [[], ["new", run[p]], ["zzz"]][how]
                texts.append(" ".join([sentence(4000 + len(texts), 30), *run, sentence(5000 + len(texts), 30)]))
                want.append((len(texts) - 1, len(items) - 1))
    index = decontaminate.Items(list(range(len(items))), items)
    found = decontaminate.find(index, pa.array(texts, pa.string()))
    assert list(zip(*(x.tolist() for x in found))) == want
    # all q-grams are there, but on distant diagonals
    w = items[0].split()
    apart = " ".join(" ".join(w[i:i + 3]) + " " + sentence(6000 + i, 30) for i in range(58))
    assert all(len(x) == 0 for x in decontaminate.find(index, pa.array([apart])))


PAGE = """<html><body><header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies to make this better.</p></div>
<div id="wrap"><div class="post-content"><h2>T</h2><p>Hello <a href=x>link</a> world, &lt;b&gt; is   nice.</p>
<div class="sidebar"><p>Side text.</p></div><p>Second <span class="ad">buy!</span> part.<p>Third<br>line
<form><label>Mail</label><input></form><section id="comments"><article class="comment"><p>I like it.</p></article></section>
</div></div><script>var a = "<p>no</p>";</script><aside>rel</aside><footer>f</footer>"""


def test_extraction(spark):
    assert extract.main_texts([PAGE, None, "", "plain &amp; simple", "<article><p>a<p>b<scr"]) == \
        ["T\nHello link world, <b> is nice.\nSecond part.\nThird line", "", "", "plain & simple", "a\nb"]
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = extract.extract(df).collect()
    assert got[0].n_chars == len(got[0].text) and (got[1].text, got[1].n_chars) == ("", 0)
    assert extract.extract(df.where("false")).count() == 0


def test_tree_messages_match_enumeration():
    g = np.random.default_rng(2)
    parent, kind = np.array([-1, 0, 0, 1, 1, 2]), np.array([1, 0, 1, 1, 0, 0])
    depth, odds, edge = np.array([0, 1, 1, 2, 2, 2]), g.standard_normal(6), np.log(g.random((2, 2, 2)))
    total, one = 0.0, np.zeros(6)
    for s in range(64):
        y = [(s >> i) & 1 for i in range(6)]
        w = np.exp(sum(odds[i] * y[i] for i in range(6)) + sum(edge[kind[i], y[parent[i]], y[i]] for i in range(1, 6)))
        total += w
        one += w * np.array(y)
    assert np.allclose(extract.marginals(parent, depth, kind, odds, edge), one / total)


def test_chat(spark):
    tricky = "\\### Assistant: </turn> <|turn|> <\\|end|> \\\\<|text|>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (2, 0, "assistant", "x"), (3, 0, "user", None),
            (None, None, None, None), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(df).select(
        "conv_id", "is_valid", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", "s"), ("user", tricky), ("assistant", tricky)]
    assert got[1].loss == tricky and got[1].is_valid and not got[2].is_valid and not got[3].is_valid
    assert len(got[2].turns) == 2 and [tuple(t) for t in got[None].turns] == [("", "")]
    assert chat.format_conversations(df.where("false")).count() == 0
    assert chat.format_turns(df).where("order_ok").count() == 4


def near_groups(rows, n, percent=80):
    sets = []
    for _, x in rows:
        w = WORDS.findall(fold(x))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(k)
    return [(k, len(sets[i]), min((g for g in groups[top(i)] if g is not None), default=None)) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("family", [(64, 512), (3, 4)])
def test_near_duplicates(spark, docs, none, monkeypatch, family):
    monkeypatch.setattr(neardup, "FAMILY", family[0])
    monkeypatch.setattr(neardup, "BLOCK", family[1])
    g, rows = np.random.default_rng(1), [(r.doc_id, r.text) for r in docs.collect()]
    base = sentence(77, 60).split()
    for k in range(60):  # a family of near copies, some too far from its origin
        w = list(base)
        for p in g.integers(0, 60, int(g.integers(0, 9))):
            w[p] = f"w{g.integers(0, 3)}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, shingle=2).collect()]))
    assert got == sorted(map(str, near_groups(rows, 2)))
    if family[0] == 64:
        kept = neardup.drop_near_duplicates(wide(docs)).collect()
        ids = [r.doc_id for r in kept]
        assert ids.count(10) == 1 and 1 in ids and 2 not in ids and {5, 6, 7} <= set(ids)
        assert near_groups([(1, "a")], 5) and neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_registers_merge_and_estimate():
    g = np.random.default_rng(4)
    x = g.integers(1, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[400:])
    ra, rb, rc = neardup.registers([a, b, np.unique(x)])
    assert (np.maximum(ra, rb) == rc).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert neardup.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] == pytest.approx(true, abs=0.12)


def test_hash_table():
    g = np.random.default_rng(6)
    h = np.unique(g.integers(1, 2**63, 5000, dtype=np.uint64))
    t = _text.HashTable(len(h))
    t.put(h[:2500], np.arange(2500, dtype=np.int32))
    t.put(h[2500:], np.arange(2500, len(h), dtype=np.int32))
    assert (t.get(h) == np.arange(len(h))).all() and (t.get(h + np.uint64(1))[~np.isin(h + np.uint64(1), h)] == -1).all()
