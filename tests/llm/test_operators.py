"""Each corpus operator against a brute-force version, and on awkward input."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywatch.llm import (
    chunk_dedup,
    common,
    decontaminate,
    lattice_lm,
    line_frequency,
    mixing,
    page_diff,
    perspectives,
    queries,
    simhash,
    toxicity,
    url_graph,
)

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, fingerprint string, size int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
EDGE = [
    (1, "Some words of a text that is here", "a", 0.5, "x", 1),
    (1, "Some words of a text that is here", "a", 0.5, "x", 1),
    (2, None, None, None, None, None),
    (3, "", "b", None, None, None),
    (4, " \t\n\x0b\x0c\r ", "b", None, None, None),
    (None, "no id at all", None, None, None, None),
    (5, LONG, "a", None, None, None),
    (6, "É É é x", "é", None, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_fingerprint(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """(id, fingerprint) pairs -> least id of each one's component, in order."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        ids[find(i)].append(doc)
    known = {k: [x for x in v if x is not None] for k, v in ids.items()}
    return [min(known[find(i)], default=None) for i in range(len(prints))]


def test_simhash_matches_all_pairs(spark, docs):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, SMALL).collect()}
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    for (doc, print_), least in zip(rows, plain_components(rows)):
        assert got[doc].fingerprint == f"{print_:016x}"
        assert got[doc].component_id == least
    assert len(got) == len(rows)


def test_simhash_edges(spark, edge, empty):
    rows = simhash.simhash_groups(edge).collect()
    assert len(rows) == len(EDGE)
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert sorted(r.doc_id for r in zero) == [2, 3, 4] and {r.component_id for r in zero} == {2}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 5, 6, None]
    assert simhash.simhash_groups(empty).count() == simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("distance", [1, 2])
def test_links_of_a_dense_group(spark, distance):
    """A posting of many members: links found without all pairs, none lost."""
    rng = np.random.default_rng(distance)
    base = int(rng.integers(1 << 62))
    values = {base ^ int(x) for x in rng.integers(0, 1 << 16, 600)}
    values |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    values |= {v ^ (1 << int(rng.integers(63))) for v in list(values)[:200]}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in simhash.components(prints, distance).collect()}
    assert [got[v] for _, v in rows] == plain_components(rows, distance)


def test_components_of_a_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.connected_components(chain.unionAll(chain)).collect()
    assert len(got) == 61 and {r.root for r in got} == {0}
    assert common.connected_components(chain.limit(0)).count() == 0


def plain_contamination(text, items, window=13):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(pattern, lower(text)), set(), set()
    for item, item_text in items:
        v = re.findall(pattern, lower(item_text))
        for i in range(max(1, len(v) - window + 1) if v else 0):
            part = v[i : i + window]
            for at in range(len(w) - len(part) + 1):
                if w[at] == part[0] and w[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("max_words", [50_000, 300])
def test_contamination_matches_brute_force(spark, docs, max_words):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = docs.collect()
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, max_words=max_words).collect()}
    hits = 0
    for r in rows:
        n, hit, found = plain_contamination(r.text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g["items"]) == (n, hit, found)
        assert g.contaminated == (hit > 0 and 20 * hit >= n)
        for s in g.spans:
            assert plain_contamination(r.text[s.first : s.past], items)[1] > 0
        hits += hit
    assert hits and len(got) == len(rows)


def test_contamination_edges(spark, edge, empty):
    bench = spark.createDataFrame(
        [(1, "Text, that is"), (2, None), (3, ""), (1, "É é"), (None, "no ID")], "item_id long, text string"
    )
    got = decontaminate.contamination(edge, bench).collect()
    assert len(got) == len(EDGE)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_hit == 3 and [tuple(s) for s in by_id[1].spans] == [(16, 28)]
    assert by_id[2].n_words == 0 and not by_id[2].contaminated
    assert by_id[6].n_hit == 0  # "É" is not lower-cased, so "é x" is another word
    kept = decontaminate.drop_contaminated(edge, bench)
    assert kept.columns == edge.columns
    assert decontaminate.drop_contaminated(empty, bench).count() == 0
    assert decontaminate.drop_contaminated(edge, bench.limit(0)).count() == len(EDGE)


def plain_gear(data):
    h, out = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup.GEAR[b])) % (1 << 32)
        out.append(h)
    return out


def test_gear_is_the_rolling_hash():
    data = bytes(np.random.default_rng(1).integers(0, 256, 500, dtype=np.uint8))
    for n in (1, 31, 32, 33, 500):
        assert chunk_dedup.gear_hashes(data[:n]).tolist() == plain_gear(data[:n])


def test_chunks_resist_insertions():
    rng = np.random.default_rng(2)
    body = [f"word{i}" for i in rng.integers(0, 5000, 400)]
    a = chunk_dedup.chunks(" ".join(body).encode())
    b = chunk_dedup.chunks(" ".join(["two", "more", *body[:200], "inserted", *body[200:]]).encode())
    assert len(set(a[1]) - set(b[1])) <= 8
    assert a[0][0] == 0 and a[0][-1] == 400


def test_passages_are_cut_from_later_documents(spark):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))
    passages = [text(int(rng.integers(51, 120))) for _ in range(60)]
    rows = []
    for i in range(180):
        rows.append((i, f"{text(80)}\n{passages[i % 60].upper() if i % 7 == 0 else passages[i % 60]}  {text(60)}"))
    clean = [(i, text(150)) for i in range(180, 240)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.dedup_passages(docs).collect()}
    for i, t in rows[:60] + clean:
        assert got[i].text == t and got[i].n_removed == 0
    for i, t in rows[60:]:
        assert got[i].n_removed >= 13 and i % 60 in got[i].owners
        n = len(passages[i % 60].split())
        assert 80 + 60 <= len(got[i].text.split()) == got[i].n_words - got[i].n_removed <= 80 + n + 60
        assert got[i].text.startswith(t[:60])
        for s in got[i].spans:
            assert t[s.first : s.past].lower() in passages[i % 60].lower()


def test_chunk_dedup_edges(spark, edge, empty):
    double = edge.unionAll(edge.withColumn("doc_id", F.col("doc_id") + 100))
    got = chunk_dedup.remove_repeats(double)
    assert got.columns == [*edge.columns, "_repeats"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 2 * len(EDGE)
    assert rows[5].text == LONG and rows[105].text == ""
    assert rows[1]._repeats.n_removed == 0 and rows[102].text is None
    assert chunk_dedup.remove_repeats(empty).count() == 0


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.op6_toxicity(spark, "/root/testdata/sf0.01").collect()
    real = {
        r.doc_id: r.toxic
        for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    }
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = [(r.score, real[r.doc_id]) for r in rows if r.held_out and r.doc_id in real]
    pos, neg = ([s for s, y in held if y == k] for k in (1, 0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75  # 260 labelled rows; 1.00 on the check tables
    assert labels.count() and sum(s >= 0.7 for s in neg) <= 2


def test_ftrl_finds_the_telling_feature():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 800)
    x = [np.append(rng.integers(100, 4000, 30), 7 + k) for k in y]
    w = toxicity.ftrl([np.unique(v) for v in x], y.astype(float))
    assert w[8] > 2 > 0 >= w[7] and (w != 0).sum() < 200


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (99, 1)], "doc_id long, toxic int"
    )
    model = toxicity.fit(edge, labels)
    got = toxicity.with_score(edge, model)
    assert got.columns[-1] == "score" and sorted(got.columns) == sorted(edge.columns)
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == len(EDGE)
    none = toxicity.fit(empty, labels.limit(0))
    assert {r.score for r in toxicity.with_score(edge, none).collect()} == {0.5}
    assert toxicity.drop_toxic(edge, none).columns == edge.columns
    again = toxicity.fit(edge.repartition(5), labels)
    assert (again.places == model.places).all() and (again.weights == model.weights).all()


def segmentations(text, pieces):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            for rest in segmentations(text[k:], pieces):
                yield [text[:k], *rest]


def test_lattice_sums_all_segmentations():
    names = ["▁", "a", "b", "ab", "▁a", "ba", "abab", "▁ab"]
    pieces = {p: math.log((i + 1) / 40) for i, p in enumerate(names)}
    spelt = [math.log(0.001)] * 256
    batch = lattice_lm.WordBatches(pieces, spelt)
    found, counts = ["abab", "b", "a" * 60, "abé", "ababab"], defaultdict(float)
    got = batch.log_probabilities([w.encode() for w in found])
    every = {**pieces, "é": 2 * math.log(0.001)}
    for w, x in zip(found, got):
        parts = [sum(every[p] for p in s) for s in segmentations("▁" + w, every)] if len(w) < 20 else []
        if parts:
            assert x == pytest.approx(math.log(sum(map(math.exp, parts))))
            total = sum(map(math.exp, parts))
            for s, weight in zip(segmentations("▁" + w, every), parts):
                for p in s:
                    counts[p] += 3 * math.exp(weight) / total
    short = [w.encode() for w in found if len(w) < 20]
    expected = batch.expected([(short, [3] * len(short))])
    assert expected.pop("<0xC3>") == expected.pop("<0xA9>") == pytest.approx(counts.pop("é"))
    assert {k: pytest.approx(v) for k, v in expected.items()} == dict(counts)


@pytest.mark.parametrize("head", [200_000, 50, 0])
def test_lm_base_matches_brute_force(spark, docs, head):
    got = {r.doc_id: r for r in lattice_lm.score_documents(docs, head=head).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {r.doc_id: [*words(lower(r.text)), None] for r in docs.collect()}
    c = Counter(t for d, ts in tokens.items() if not held(d) for t in ts)
    n, v = sum(c.values()), len(c)
    for d, ts in tokens.items():
        g = got[d]
        assert (g.held_out, g.n_tokens, g.train_tokens) == (held(d), len(ts), n)
        assert g.n_known == sum(t in c for t in ts)
        assert g.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
        assert -1e7 < g.score < 0
    if head == 50:
        whole = {r.doc_id: r.score for r in lattice_lm.score_documents(docs).collect()}
        assert all(got[d].score == pytest.approx(whole[d]) for d in tokens)


def test_lm_edges(spark, edge, empty):
    got = {r.doc_id: r for r in lattice_lm.score_documents(edge).collect()}
    assert got[2].n_tokens == got[3].n_tokens == got[4].n_tokens == 1
    assert got[5].n_tokens == 30_001 and lattice_lm.score_documents(empty).count() == 0


def plain_repeats(w):
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})


def plain_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(s) for s in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        plain_repeats(w),
    )


def test_line_frequency_counts(spark, docs, edge, empty):
    for df in (docs, edge):
        got = line_frequency.judge(df).collect()
        rows = df.collect()
        want = sorted(str((r.doc_id, *plain_base(r.text))) for r in rows)
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        assert sorted(str(tuple(r[n] for n in names)) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert line_frequency.judge(empty).count() == 0


def test_frequent_lines_deplete(spark):
    body = lambda i: "\n".join(" ".join(f"d{i}l{k}w{j}" for j in range(20)) for k in range(4))
    menu = "\n".join(" ".join(f"menu{k}x{j}" for j in range(30)) for k in range(10))
    rows = [(i, body(i), "h") for i in range(60)]
    rows += [(100 + i, f"{menu}\n{body(100 + i)[:200]}", "h") for i in range(40)]
    rows += [(200 + i, f"  {menu.upper()}", "other") for i in range(5)]
    rows += [(300 + i, body(300), "h") for i in range(200)]  # exact copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.judge(docs).collect()}
    assert {d for d, r in got.items() if not r.kept} == set(range(100, 140))
    assert all(got[100 + i].n_removed_lines == 10 for i in range(40))
    text = {r.doc_id: r.text for r in line_frequency.clean_lines(docs).collect()}
    assert text[5] == body(5) and text[101] == body(101)[:200] and text[200].strip() == menu.upper()


def test_url_rules(spark):
    urls = {
        "http://Www.Example.COM/en/1": ("com", "www.example.com/en/", "allow"),
        "http://x.example.com/en/1?q": ("com", "example.com/en/", "block"),
        "http://example.com/fr/": ("com", "com/", "allow"),
        "http://example.com": ("com", None, "allow"),
        "http://badexample.com/en/1": ("com", "com/", "allow"),
        "https://a.net/es/1#x": ("net", "net/es/", "block"),
        "https://a.net/en/1": ("net", None, "block"),
        "https://b.org/es/1": ("org", None, "allow"),
        "//b.org/es/1": ("", None, "allow"),
        "": ("", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(99, None, None)]
    got = url_graph.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"))
    found = {r.page_id: r for r in got.collect()}
    for (i, url, _), (end, rule, verdict) in zip(rows, urls.values()):
        r = found[i]
        assert r.host.endswith(end) and (r.rule, r.verdict) == (rule, verdict), url
    assert (found[99].host, found[99].path, found[99].verdict) == ("", "", "allow")
    assert found[0].path == "/en/1" and found[3].path == ""
    assert got.limit(0).count() == 0


def test_trust_spreads_over_links(spark):
    page = lambda *to: "".join(f'<p><A class="x" href="http://{t}/p">t</a>' for t in to)
    rows = [
        ("http://good.com/a", page("near.org", "NEAR.org", "good.com")),
        ("http://near.org/a", page("far.org")),
        ("http://far.org/a", None),
        ("http://bad.net/es/a", page("bad.net")),
        ("http://fan.org/a", page("bad.net")),
        ("http://fan2.org/a", page("fan.org", "unknown.org")),
        ("http://sub.fan2.org/a", ""),
        ("http://alone.org/a", "<a href='/x'>"),
    ]
    rows = [(i, u, h) for i, (u, h) in enumerate(rows)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.host: r for r in url_graph.judge_urls(pages).collect()}
    verdicts = {h: r.verdict for h, r in got.items()}
    assert [verdicts[h] for h in ("near.org", "far.org", "alone.org")] == ["allow"] * 3
    assert [verdicts[h] for h in ("fan.org", "fan2.org", "sub.fan2.org")] == ["block"] * 3
    # by hand: the seed's trust, damped twice along the chain
    assert got["near.org"].trust == pytest.approx(0.15 * 0.85)
    assert got["far.org"].trust == pytest.approx(0.15 * 0.85**2)
    plan = url_graph.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mixing(spark, docs, edge, empty):
    mixed = docs.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    rows = mixing.copies(mixed).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.copies <= 2
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies
    want = plain_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.1)
    again = {r.doc_id: r.copies for r in mixing.copies(mixed.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    out = mixing.mix(edge)
    assert out.columns == [*edge.columns, "copy"]
    assert mixing.copies(empty).count() == mixing.mix(empty).count() == 0
    assert mixing.copies(edge.where("size is null and score is null and doc_id in (3, 4)")).count() == 2


def test_perspectives_edges(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "ann", "hi <|end|>"),
        (1, 2, "bob", None),
        (1, 2, "bob", None),
        (1, None, None, "late"),
        (1, 300, "ann", "é!"),
        (None, 0, "ann", "alone"),
        (2, 0, "system", "nobody"),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): r for r in perspectives.rotate(talks).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "ann", 0]
    assert r.text == (
        "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n"
    )
    assert [r.text[m.first : m.past] for m in r["mask"]] == ["hi < |end|>"]
    assert got[1, "ann", 2].text == "<|assistant|>\né!<|end|>\n"
    assert got[1, "unknown", -1].n_messages == 1 and got[1, "bob", 0].n_messages == 3
    assert perspectives.rotate(talks.limit(0)).count() == 0


def test_crowded_turns_are_dealt_out(spark):
    talks = spark.range(3000).select(
        F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("a").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    got = perspectives.rotate(talks).collect()
    assert sum(r.n_messages for r in got) == 3000 and max(r.n_messages for r in got) <= 1024


def test_page_lines():
    page = (
        "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><ul><li>Menu</ul></nav>"
        "<!-- x --><div class='ad'>Buy <div>now</div></div><article><h1>Head&amp;line</h1>"
        "<p><b>One  two<br><p>Three &lt;four&gt; caf&eacute;</p><div class=comments><p>First!</p></div>"
        "<aside>side</aside><form><input>q</form><p>a&nbsp;b</p></article><footer>&copy; x</footer>"
    )
    lines, known = page_diff.page_lines(page)
    assert known and lines == ["Head&line", "One two", "Three <four> café", "a b"]
    for text in (None, "", "<p", "<<<>>>", "<script>never closed", "<div class=\"x>", "a < b"):
        page_diff.page_lines(text)
    assert page_diff.page_lines("plain & simple")[0] == ["plain & simple"]


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 6, rng.integers(0, 15))] for _ in range(2))
        got = [a[i] for i in sorted(page_diff.shared_lines(a, b))]
        assert len(got) == plain_lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in got)


def test_loose_pages_are_differenced(spark):
    page = lambda i: f"<div>Top of the site</div><p>{'own words ' * 5}{i}</p><p>Contact us</p>"
    rows = [(i, f"http://h.com/a/{i:03}", page(i)) for i in range(50)]
    rows += [(60, "http://one.com/", page(60)), (61, None, page(61)), (62, "http://h.com/b", None)]
    rows += [(70, "http://c.com/1", page(7)), (71, "http://c.com/2", page(7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (pages, pages.repartition(9)):
        got = {r.page_id: r.text for r in page_diff.main_text(df).collect()}
        assert len(got) == len(rows)
        assert all(got[i] == f"{'own words ' * 5}{i}" for i in range(50))
        assert got[60].startswith("Top of the site\n") and got[62] == ""
        assert got[70] == got[71] != ""  # copies keep their lines
    assert page_diff.main_text(pages.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    got = queries.op10_page_diff(spark, SMALL).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub("<[^>]*>", " ", b) for b in re.split("</?(?:h1|p)>", article)]
        import html

        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", ["op2_url_graph", "op3_decontaminate", "op9_mixing"])
def test_sql_twins_on_awkward_rows(spark, tmp_path, edge, name):
    """Nulls, empty texts, repeated rows and an item shorter than a window, in both forms."""
    duck = duckdb.connect()
    words_13 = " ".join(f"b{i}" for i in range(13))
    page = '<a href="//B.org/x">b</a> <a <a class=x href=http://net>n</a>'
    tables = {
        "documents": edge.unionByName(
            spark.createDataFrame(
                [(7, f"So: {words_13} and more", "c", None, None, None), (8, "b3", "c", None, None, None)],
                DOCS,
            )
        ),
        "benchmark": spark.createDataFrame(
            [("i2", words_13 + " b13"), ("i1", "TEXT, that"), ("i0", None), ("i3", "is here"), ("i3", "É")],
            "item_id string, text string",
        ),
        "pages": spark.createDataFrame(
            [
                (1, "http://a.net/es/1", page),
                (2, "http://B.org/", None),
                (3, None, ""),
                (3, None, ""),
                (4, "nothing", page),
                (5, "https://sub.b.org?q", ""),
                (None, "x://Example.com/en/", page),
                (6, "http://example.com", None),
            ],
            "page_id long, url string, html string",
        ),
    }
    for table, df in tables.items():
        path = str(tmp_path / f"{table}.parquet")
        df.coalesce(1).write.parquet(path)
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    result = duck.execute(queries.ORACLES[name])
    assert got.columns == [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
