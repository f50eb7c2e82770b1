"""The ten operators against brute force, exact round trips and SQL, with nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerflow.llm import components, exact_dedup, html_extract, mixing, ngram_join, pii, piece_lattice, quality, queries, token_count, token_output, vector_dedup
from ledgerflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, node long, id long, component string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_texts(seed=0, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "dälta", "eps", "zeta", "eta", "theta", "iota", "kappa", "中文", "🙂x"]
    out = [None, "", " ", "\n\t ", "one", "two words", "Two WORDS", "two  words", "a b c", "A\tb\x0bc", "x y z", "▁ a ▁b", "end ", " start", "a\x00b c"]
    for _ in range(n):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.choice([3, 12, 30, 60, 120]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(9))
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    return out


def frame(spark, texts):
    rows = [(i * 3 + 1, t, f"s{i % 4}" if i % 7 else None, i, -i, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, width, num):
    texts = edge_texts(width)
    got = by_id(ngram_join.ngram_jaccard_components(frame(spark, texts), width=width, threshold=num / 100))
    sets = {i * 3 + 1: shingles(t, width) for i, t in enumerate(texts)}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = smallest_reachable(ids, links)
    assert len(links) > 20
    assert {i: (r.n_grams, r.component) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in ids}


def test_ngram_join_blocks_and_small_flushes(spark, monkeypatch):
    texts = edge_texts(9)
    whole = by_id(ngram_join.ngram_jaccard_components(frame(spark, texts)))
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 2)
    monkeypatch.setattr(ngram_join, "HELD_SIGNATURES", 50)
    assert by_id(ngram_join.ngram_jaccard_components(frame(spark, texts))) == whole


def test_trie_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        pool = rng.integers(1, 2**63, 60, dtype=np.uint64)
        sets = []
        for _ in range(rng.integers(2, 25)):
            base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.choice(pool, 40, replace=False)
            keep = base[rng.random(len(base)) > 0.04]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, rng.integers(0, 3))])))
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))]
        want = smallest_reachable(range(len(sets)), links)
        assert ngram_join.trie_components(sets, 0.9).tolist() == [want[i] for i in range(len(sets))]


def test_signatures_meet_for_all_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for t in (0.8, 0.9):
        classes = ngram_join.size_classes(t, 3000)
        for _ in range(300):
            n = int(rng.integers(2, 1500))
            both = ngram_join.mix(rng.integers(1, 2**63, n, dtype=np.uint64))
            union = int(n / t + 1e-9)
            left = int(rng.integers(0, union - n + 1))
            extra = ngram_join.mix(rng.integers(1, 2**63, union - n, dtype=np.uint64))
            a, b = np.unique(np.concatenate([both, extra[:left]])), np.unique(np.concatenate([both, extra[left:]]))
            if len(extra):
                assert np.intersect1d(ngram_join.signatures(a, t, classes), ngram_join.signatures(b, t, classes)).size


def test_components(spark):
    from ledgerflow.llm.common import Workspace

    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None), (None, None), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == smallest_reachable({x for p in real for x in p}, real)
    assert components.connected_components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), None if i % 11 == 0 else f"s{'a' if i % 5 else i % 13}") for i in range(3000)] + [(9000, None, "s1"), (9001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str)
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    fixed = {}
    while True:
        level = (sum(size.values()) - sum(fixed.values())) / sum(weight[s] for s in order if s not in fixed)
        over = [s for s in order if s not in fixed and weight[s] * level > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3 * size[s] for s in over}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(fixed.get(r.source, weight[r.source] * level))
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - fixed.get(s, weight[s] * level)) <= 30
    weighted = by_id(mixing.mix_sources(df.withColumn("w", df.doc_id % 3), weight_col="w"))
    assert all(weighted[i].copies == 0 for i in range(0, 3000, 3))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_exact_dedup_and_index_append(spark):
    texts = [None, "", " ", "a b", "a\t\nb", "a b ", "x" * 300_000, "x" * 300_000] + ["same"] * 40
    index = exact_dedup.fresh_index(spark)
    got = by_id(exact_dedup.exact_duplicates(frame(spark, texts), index))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i * 3 + 1)
    for norm, ids in groups.items():
        for i in ids:
            assert tuple(got[i]) == (i, min(ids), len(ids), i == min(ids), hashlib.sha256(norm.encode()).hexdigest())
    again = exact_dedup.DigestIndex(spark, index.path, index.buckets)
    more = spark.createDataFrame([(0, "a  b"), (500, "new"), (501, "new")], "doc_id long, text string")
    second = by_id(exact_dedup.exact_duplicates(more, again))
    assert (second[0].keep_id, second[0].kept, second[500].kept, second[501].keep_id) == (10, False, True, 500)
    assert again.table().count() == len(groups) + 1
    assert exact_dedup.exact_duplicates(more.limit(0), exact_dedup.fresh_index(spark)).count() == 0


def test_hot_and_cold_digests_agree(spark, monkeypatch):
    texts = ["same"] * 30 + edge_texts(2)
    whole = by_id(exact_dedup.exact_duplicates(frame(spark, texts), exact_dedup.fresh_index(spark)))
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 8)
    assert by_id(exact_dedup.exact_duplicates(frame(spark, texts), exact_dedup.fresh_index(spark))) == whole


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    texts = [*edge_texts(6), "<s> x </s> <unk>", "a   b    c\n\n d", "tail  ", "é ́x", "한글 ﬁ"]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_count.PieceCounter(path).cuts
    got = by_id(token_count.token_counts(frame(spark, texts), path, limit=50))
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert tuple(got[i * 3 + 1]) == (i * 3 + 1, len((t or "").encode()), n, n > 50)


ARTICLE = "<article><h1>Head line</h1><p>First &amp; best\n text.<p>Second <b>bold</b>text<br>after</article>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/x>menu item</a></nav><div class='ad box'>buy this</div>{ARTICLE}<footer>foot</footer></body></html>", "Head line First & best text. Second boldtext after"),
        (f"<body><header><h1>Site</h1></header>{ARTICLE}<section id=comments><p>{'reader says ' * 200}</p></section>", "Head line First & best text. Second boldtext after"),
        ("<body><ul class=menu><li><a href=1>one</a><li><a href=2>two</a></ul><div><p>Long text of the page that stands here.</p><p>And more of it, to the end.</p></div><form>name <input> <button>go</button></form>", "Long text of the page that stands here. And more of it, to the end."),
        ("<body><script>var a='</p>'; if (a<b) {}</script><p>Only &lt;this&gt; stays<!-- not this --></p>", "Only <this> stays"),
        ("<body><div class='sidebar'><p>side</p></div><main><table><tr><td>a<td>b</table></main>", "a b"),
        ("<script>only script", ""),
    ],
)
def test_html_extraction(page, want):
    assert html_extract.extract(page) == want


def test_html_extraction_of_test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = by_id(queries.op5_html_extraction(spark, sf_dir), "page_id")
    import html

    for i, page in pages.items():
        inner = re.sub(r"(?s).*<article>|</article>.*", "", page)
        inner = re.sub(r"<(p|h1|br|/p|/h1)>", " ", inner)
        assert got[i].text == " ".join(html.unescape(re.sub("<[^>]+>", "", inner)).split()) and got[i].n_chars == len(got[i].text)


def test_pieces_round_trip_and_are_reproducible(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = [*edge_texts(8), "ab" * 2000, "x" * 41 + " y", "▁▁ ▁"]
    df = frame(spark, texts)
    encoded = piece_lattice.sample_pieces(df, path)
    first = {r.id: r.ids for r in encoded.collect()}
    assert first == {r.id: r.ids for r in piece_lattice.sample_pieces(df.repartition(5), path).collect()}
    assert {r.id: r.text for r in piece_lattice.decode_pieces(encoded, path).collect()} == {i * 3 + 1: t or "" for i, t in enumerate(texts)}
    other = {r.id: r.ids for r in piece_lattice.sample_pieces(df, path, seed=1).collect()}
    assert sum(first[i] != other[i] for i in first) > 30
    assert all(r.lossless for r in piece_lattice.check_pieces(piece_lattice.sample_pieces(df, path, keep_text=True), path).collect())


def test_pieces_follow_the_lattice_distribution():
    lattice = piece_lattice.PieceLattice(tokenizer_path("piece_bpe_32k.model"), alpha=0.0003)
    unit, n = "that", 20_000
    weights = {}

    def walk(rest, ids, w):
        if not rest:
            weights[tuple(ids)] = w
        for k in range(1, len(rest) + 1):
            i = lattice.plain.get(rest[:k])
            if i is not None:
                walk(rest[k:], [*ids, i], w * lattice.weight[i])

    walk("▁" + unit, [], 1.0)
    total = sum(weights.values())
    for long in (False, True):
        if long:
            seen = collections.Counter()
            keys = piece_lattice.mix(np.arange(2000).astype(np.uint64))
            for k in keys:
                out = np.full(5, -1, np.int64)
                lattice._long("▁" + unit, k, 0, 0, out)
                seen[tuple(out[out >= 0].tolist())] += 1
        else:
            flat, edge = lattice.sample([unit] * n, np.arange(n))
            seen = collections.Counter(tuple(flat[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:]))
        m = sum(seen.values())
        for ids, w in weights.items():
            p = w / total
            assert abs(seen[ids] / m - p) < 5 * (p * (1 - p) / m) ** 0.5 + 2 / m


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    texts = [*edge_texts(10), "It's <|endoftext|>x y<|startoftext|>", "Áb ́c", "tab\tand\x85next wide", "Σίσυφος ΣΑΣ"]
    token_output.write_token_files(frame(spark, texts), str(tmp_path / "ids"), path, partitions=5)
    rows = token_output.read_token_files(spark, str(tmp_path / "ids")).orderBy("start").collect()
    model = Tokenizer.from_file(path)
    assert token_output.WordEncoder(path).cuts
    start = 0
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == len(texts)
    for r in rows:
        want = [*model.encode(texts[(r.doc_id - 1) // 3] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids) == (start, len(want), want)
        start += len(want)
    crc = by_id(token_output.ids_crc32(token_output.read_token_files(spark, str(tmp_path / "ids"))), "doc_id")
    assert all(crc[r.doc_id].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert {(r.doc_id, r.start) for r in token_output.token_positions(spark, str(tmp_path / "ids")).collect()} == {(r.doc_id, r.start) for r in rows}


def base_spans(text):
    """The contract's patterns, run plainly."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_equals_patterns():
    automaton = pii._automaton()
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", " ", "+", "+1", "12", "255", "256.", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "0", "7-", "(555)", "% ", "é", "x@y", "http://a.b/c", "account: 12345678", "password=abcdef99"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert [s for s in pii.find_spans(text, automaton) if s[0] in pii.BASE_KINDS] == base_spans(text), text


def test_pii_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = by_id(queries.op8_pii(spark, sf_dir), "doc_id")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.as_text(want).encode()).hexdigest() and got[i].n_email == sum(s[0] == "email" for s in want)
    assert [r.spans for r in pii.personal_data(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()] == [[], []]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality_classifier(spark, sf).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 40 and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_edges(spark):
    docs = frame(spark, edge_texts(1)).withColumnRenamed("component", "quality_score")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert {r.quality_score for r in quality.quality_scores(docs, model).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), model).count() == 0
    x = quality.features(pa.array(["", "a a a a", "WORD!! WORD!!"]))
    assert np.isfinite(x).all() and x[1, 4] > 0.8 and x[2, 1] == 1


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    vectors = [b.tolist() for b in base] + [(base[i % 20] + 0.08 * rng.standard_normal(16)).tolist() for i in range(150)] + [base[0].tolist()] * 5 + [(2 * base[1]).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, None] + [0.0] * 14, [1.0] * 3, [2.0] * 3]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([*vectors, *odd])], "vec_id long, embedding array<double>, id string")
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = len(vectors)
    near = x @ x.T >= 0.9
    links = [(i, j) for i in range(n) for j in range(i) if near[i, j]] + [(n + 6, n + 7)]
    want = smallest_reachable(range(n + len(odd)), links)
    degree = collections.Counter(i for p in links for i in p)
    for block in (vector_dedup.BLOCK, 7):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        got = by_id(vector_dedup.near_duplicate_vectors(df, miss=1e-6))
        assert {i: (r.n_links, r.component) for i, r in got.items()} == {i: (degree[i], want[i]) for i in range(n + len(odd))}
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*columns).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    path = tokenizer_path("piece_bpe_32k.model")
    for out in (ngram_join.ngram_jaccard_components(docs), token_count.token_counts(docs, path), piece_lattice.sample_pieces(docs, path), pii.personal_data(docs)):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert sum(q for i, q in labels.items() if i in kept) >= 0.98 * sum(labels.values())
    ids = {r.doc_id for r in corpus_pipeline.exact_stage(spark, good, sf).collect()}
    first = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    assert ids == set(first.values())
    out = corpus_pipeline.run(spark, sf).collect()
    assert len(out) > 300 and {r.doc_id for r in out} <= ids
