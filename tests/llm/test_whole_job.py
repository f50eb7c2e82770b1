"""Rows, texts and markup that an operator once passed over."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerflow.llm import exact_dedup, html_extract, pii, piece_lattice
from ledgerflow.llm.queries import tokenizer_path

BODY = "".join(f"<p>Paragraph {i} of the real text, which runs on for a good while and says something at length.</p>" for i in range(6))
TEASERS = "".join(f"<article><a href=/{i}><h3>Teaser {i}</h3></a></article>" for i in range(4))


def test_html_body_in_a_div_beside_teasers_in_articles():
    for page in (f"<body><div class=content>{BODY}</div><section>{TEASERS}</section></body>", f"<body><div>{TEASERS}</div><div>{BODY}</div></body>"):
        got = html_extract.extract(page)
        assert all(f"Paragraph {i} of" in got for i in range(6)) and "Teaser" not in got


def test_html_sibling_articles():
    posts = "".join(f"<article><h2>Post {i}</h2><p>Post number {i} tells its whole story here, {'with more and more words ' * (i + 1)}to the end.</p><p>And a second paragraph {i}.</p></article>" for i in range(3))
    got = html_extract.extract(f"<body><nav><a href=/>home</a></nav><div>{posts}</div><footer>foot</footer></body>")
    assert all(f"number {i} tells" in got and f"second paragraph {i}." in got for i in range(3)) and "home" not in got and "foot" not in got


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><p class="ad">buy<p>First text.<p>Second text.', "First text. Second text."),
        ('<body><div><p class="notice">buy</div><p>First text.</p><p>Second text.</p>', "First text. Second text."),
        ('<body><ul><li class="promo">buy<li>First text.<li>Second text.</ul>', "First text. Second text."),
        ("<head><title>t</title><meta name=a><p>First text.<p>Second text.", "First text. Second text."),
        ('<body><div class="ad"><div>buy</div><p>this<p>now</div><p>First text.<p>Second text.', "First text. Second text."),
        ('<body><p>See <a href="/hidden-falls">the falls</a> today.</p>', "See the falls today."),
        ('<body><p title="hidden treasures">First text.</p>', "First text."),
        ('<body><p data-hidden="false" data-class="ad">First text.</p>', "First text."),
        ('<body><p>See <a href="?grid=menu">the grid</a> and <a href=?id=menu>more</a>.</p>', "See the grid and more."),
        ('<body><p hidden>not this</p><p HIDDEN=hidden>nor this</p><p aria-hidden="true">nor</p><p style="display: none">nor</p><p>First text.</p>', "First text."),
    ],
)
def test_html_skips_only_the_unwanted_element(page, want):
    assert html_extract.extract(page) == want


#: Null ids, repeated rows, and a repeated id with two texts of which 3 holds one.
ROWS = [(None, "only a null id has this text"), (None, "shared text here"), (1, "shared text here"), (3, "text of number three"), (5, "text of number three"), (5, "five has another text"), (7, "seven comes twice"), (7, "seven comes twice")]


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_pipeline_quality_stage_scores_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = pairs(corpus_pipeline.quality_stage(spark, docs, sf))
    (_, text), *_ = good
    more = pairs(corpus_pipeline.quality_stage(spark, docs.unionByName(corpus(spark, [(None, text)] * 2)), sf))
    assert more == good + collections.Counter({(None, text): 2})


def test_pipeline_exact_stage_decides_rows(spark):
    got = pairs(corpus_pipeline.exact_stage(spark, corpus(spark, ROWS), ""))
    assert got == collections.Counter([ROWS[0], ROWS[2], ROWS[3], ROWS[5], ROWS[6], ROWS[7]])


def test_pipeline_near_stage_keeps_null_ids_and_repeated_rows(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, "a null id with its own words"), (None, "a null id with its own words"), (2, " ".join(words)), (4, " ".join([*words[:-1], "x"])), (7, "seven comes twice in here"), (7, "seven comes twice in here")]
    assert pairs(corpus_pipeline.near_stage(spark, corpus(spark, rows), "")) == collections.Counter([r for r in rows if r[0] != 4])


def test_pipeline_mix_stage_copies_rows(spark):
    rows = [(None, f"null number {i}") for i in range(5)] + [(7, "seven comes many times")] * 4 + [(8, "eight one"), (8, "eight has more words than one")] + [(i, f"text {i}") for i in range(10, 30)]
    docs = corpus(spark, rows)
    got = corpus_pipeline.mix_stage(spark, docs, "")
    assert got.columns == docs.columns
    #: One source has all the weight, so its target is its size and every row is taken once.
    assert pairs(got) == collections.Counter(rows)


def test_pipeline_encode_stage_takes_every_row(spark):
    out = corpus_pipeline.encode_stage(spark, corpus(spark, ROWS), "").collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in ROWS) and all(r.ids for r in out)


def test_pieces_of_several_spaces_are_in_the_lattice():
    #: At alpha 0 all pieces weigh the same, so all segmentations of a unit are equally likely.
    lattice = piece_lattice.PieceLattice(tokenizer_path("piece_bpe_32k.model"), alpha=0.0)
    want = set()

    def walk(rest, ids):
        if not rest:
            want.add(tuple(ids))
        for k in range(1, len(rest) + 1):
            i = lattice.plain.get(rest[:k])
            if i is not None:
                walk(rest[k:], [*ids, i])

    walk("▁▁▁▁to", [])
    assert any(lattice.raw[i] == b"    " for ids in want for i in ids)
    n = 300 * len(want)
    flat, edge = lattice.sample(["   to"] * n, np.arange(n))
    seen = collections.Counter(tuple(flat[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:]))
    assert set(seen) == want and all(abs(x - 300) < 120 for x in seen.values())
    slow = set()
    for k in piece_lattice.mix(np.arange(n).astype(np.uint64)):
        out = np.full(6, -1, np.int64)
        lattice._long("▁   to", k, 0, 0, out)
        slow.add(tuple(out[out >= 0].tolist()))
    assert slow == want
    for text in ("  ", " a", "a  b", "a   ", "a \u2581  \u2581\u2581 b", "x" * 50 + " " * 60 + "y"):
        assert lattice.decode(lattice.sample([text], np.arange(1))[0].tolist()) == text


def test_pii_spans_reach_the_closing_boundary():
    found = pii._automaton()
    for cue, value in (("token=", "eyJ" + "aB3_-." * 200), ('secret: "', "s" * 129), ("iban: ", "DE" + "1234567890" * 6), ("account no: ", "12345678é9"), ("acct=", "A1234567_89")):
        text = f'see {cue}{value}" and more'
        at = text.index(value)
        assert [s for s in pii.find_spans(text, found) if s[0] in ("account", "secret")] == [("account" if cue[0] in "ia" else "secret", at, at + len(value))]


def test_exact_dedup_meets_the_index_by_anti_join_always(spark):
    first = exact_dedup.fresh_index(spark)
    second = exact_dedup.DigestIndex(spark, first.path, first.buckets)
    docs = corpus(spark, [(1, "one"), (2, "two"), (3, "two")])
    assert exact_dedup.exact_duplicates(docs, first).count() == 3
    #: Opened while the index was empty, filled since.
    assert exact_dedup.exact_duplicates(docs, second).count() == 3 and second.table().count() == 2


def test_exact_dedup_aggregates_before_the_anti_join(spark):
    index = exact_dedup.fresh_index(spark)
    digests = spark.range(100).select("id", exact_dedup.text_digest(F.lit("one")).alias("text_sha256"))
    plan = index.unseen(digests)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")
    assert index.unseen(digests).count() == 1
