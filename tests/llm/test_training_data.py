"""Training-data operators against brute force, with nulls, empty and repeated rows, and extra columns."""
import random
import re
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from beatwise.llm import chat_format, decontamination, html_content, jaccard_join, line_dedup, packing, queries, topk, url_reputation

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, mark string, place string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "m", "p") for i, t in rows], DOCS)


def words(a, n):
    return " ".join(f"w{a}x{i}" for i in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def deleted_by_definition(texts, least=50):
    lines = {i: t.split("\n") for i, t in sorted(texts.items()) if t is not None}
    size = {i: [len(WORD.findall(x)) for x in l] for i, l in lines.items()}
    seen, gone = defaultdict(list), defaultdict(set)
    for i, own in lines.items():
        for p, line in enumerate(own):
            for j, q in seen[line]:
                n, other = 0, lines[j]
                while p + n < len(own) and q + n < len(other) and own[p + n] == other[q + n]:
                    n += 1
                if sum(size[i][p:p + n]) >= least:
                    gone[i] |= set(range(p, p + n))
            seen[line].append((i, p))
    return {i: "\n".join(x for k, x in enumerate(l) if k not in gone[i]) for i, l in lines.items()}


def test_line_dedup_by_definition(spark, texts):
    got = {r["doc_id"]: r["text"] for r in queries.op1_line_dedup(spark, SF).collect()}
    want = deleted_by_definition(texts)
    assert {i: t for i, t in got.items() if t is not None} == want and want != texts


def test_line_dedup_edges(spark):
    run = "\n".join(words(i, 9) for i in range(6))
    rows = [(1, run), (2, "own\n" + run + "\nshort"), (3, None), (4, ""), (None, run), (5, run + "\nmine\n" + run)]
    got = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in line_dedup.dedup(documents(spark, rows)).collect()}
    assert got[None] == (run, 0) and got[1] == ("", 6) and got[2] == ("own\nshort", 6) and got[5] == ("mine", 12)
    assert got[3] == (None, 0) and got[4] == ("", 0)
    assert line_dedup.dedup(documents(spark, [])).count() == 0


def component_by_definition(texts):
    def shingles(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join_by_definition(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, SF).collect()}
    assert got == component_by_definition(texts)


def test_jaccard_join_splits_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "REGION_DOCS", 6)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)
    rows = {}
    for i in range(40):
        base = words("c", 60).split()
        base[(7 * i) % 60] = f"v{i % 5}"
        base[(11 * i) % 60] = f"u{i % 13}"
        rows[i] = " ".join(base)
    rows |= {100 + i: words("d", 30 + i) for i in range(20)} | {200: None, 201: "", 202: "a b", 203: "A  b"}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(documents(spark, rows.items())).collect()}
    assert got == component_by_definition(rows)


def test_region_links_over_unmeasured_pairs():
    sets = [[*range(87), *range(200, 213)], range(100), [*range(93), *range(100, 107)]]
    frame = pd.DataFrame({"doc_id": [1, 2, 3], "known": [0, 0, 3], "shingles": [np.array(s, "uint64").tobytes() for s in sets]})
    assert jaccard_join._region_links(frame, 85) == [(2, 3)]


def test_jaccard_join_links_chains(spark):
    rng, rows = random.Random(4), []
    for chain in range(300):
        n = rng.randint(40, 200)
        most = max(1, int(0.02 * n))

        def edited(of, mark):
            return [f"{mark}{chain}e{i}" if i in where else x for where in [rng.sample(range(n), most)] for i, x in enumerate(of)]

        h = words(chain, n).split()
        p0, p1 = edited(h, "a"), edited(h, "b")
        rows += [" ".join(t) for t in (h, p0, p1, edited(p1, "c"))]
    rows = dict(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(documents(spark, rows.items())).collect()}
    assert got == component_by_definition(rows)


def test_jaccard_join_reads_sets_of_possible_links_only(spark, monkeypatch):
    rows = {100: words("l", 100), 101: words("l", 100) + " end"}
    for i in range(40):
        shared = words(f"s{i}", 20)
        rows |= {2 * i: words(f"a{i}", 80) + " " + shared, 2 * i + 1: words(f"b{i}", 80) + " " + shared}
    read, sets_of = [], jaccard_join.sets_of
    monkeypatch.setattr(jaccard_join, "sets_of", lambda docs, size: read.append(docs.select("doc_id")) or sets_of(docs, size))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(documents(spark, rows.items())).collect()}
    assert got == component_by_definition(rows)
    assert {r["doc_id"] for r in read[0].collect()} == {100, 101}


def test_jaccard_join_settles_unsplit_regions_in_one_step(spark, monkeypatch):
    # Sixty sets alike by two thirds but for three pairs: no pivot parts them, and few are tied to one.
    monkeypatch.setattr(jaccard_join, "REGION_DOCS", 8)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 4)
    own = {i: [*range(40), *range(100 * i, 100 * i + 10)] for i in range(1, 58)}
    own |= {i + 100: [*own[i], 9999] for i in (7, 30, 56)}
    sets = spark.createDataFrame([(i, np.array(s, "uint64").tobytes()) for i, s in own.items()], jaccard_join.SETS)
    regions = spark.createDataFrame([("r", i, i) for i in own], "region string, doc_id long, known long")
    cuts, cut = [], jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: cuts.append(1) or cut(df))
    found = {tuple(sorted((r["doc_id"], r["other"]))) for r in jaccard_join._join_regions(regions, sets, 85).collect()}
    assert found == {(7, 107), (30, 130), (56, 156)}
    assert len(cuts) < 14  # a round; four pivots a round took about fourteen rounds


def test_jaccard_join_common_counts(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 3)
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 30, rng.integers(1, 20)).astype("uint64")) for _ in range(n)] for n in (7, 5))
    by_sets = lambda x, y: [[len({*p.tolist()} & {*q.tolist()}) for q in y] for p in x]
    assert jaccard_join.common_counts(a, b).tolist() == by_sets(a, b)
    own = jaccard_join.common_counts(a, a)
    assert all(own[i, j] == by_sets(a, a)[i][j] for i in range(7) for j in range(7) if i != j)


def test_jaccard_join_orders_leads_without_texts(spark):
    rng = np.random.default_rng(5)
    rows = {i: " ".join(f"w{x}" for x in rng.integers(0, 25, rng.integers(1, 60))) for i in range(60)}
    docs = documents(spark, rows.items())
    frequent = np.unique(np.concatenate([jaccard_join.shingle_set(rows[i], 2, jaccard_join.WordHashes()) for i in range(0, 60, 4)]))
    heads = jaccard_join.leading(docs, np.empty(0, "uint64"), 2, 85)
    plain = {r["doc_id"]: r["leading"] for r in jaccard_join.leading(docs, frequent, 2, 85).collect()}
    assert {r["doc_id"]: r["leading"] for r in jaccard_join._reordered(docs, heads, docs.select("doc_id"), frequent, 2, 85).collect()} == plain
    told = [r["leading"] for r in jaccard_join._ordered(heads, frequent, 85).collect()]
    assert None in told and any(told)


def test_jaccard_join_empty(spark):
    assert jaccard_join.classes(documents(spark, [])).count() == 0
    assert jaccard_join.keep_one(documents(spark, [(1, "a b"), (2, "A b"), (3, None)])).count() == 2


def test_jaccard_join_repeated_ids(spark):
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(1, a), (1, b), (1, b), (6, b + " end"), (7, a + " end"), (8, c), (8, c), (9, ""), (9, c + " end"), (None, a), (3, b + " last"), (2, None)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(documents(spark, rows)).collect() if r["n_shingles"])
    assert got == [(0, 57, None), (1, 57, 1), (1, 57, 1), (1, 57, 1), (3, 58, 1), (6, 58, 1), (7, 58, 1), (8, 57, 8), (8, 57, 8), (9, 58, 8)]
    kept = jaccard_join.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, a), (1, a), (2, ""), (8, c)]


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, words("b", 20)), (2, "Tiny item"), (3, None), (10, words("b", 14))], "item_id long, text string")
    rows = [(1, "x " * 30 + words("b", 20)), (2, words("b", 12)), (3, "a TINY, item!"), (4, None), (5, ""), (3, "a TINY, item!"), (None, words("b", 13))]
    got = decontamination.report(documents(spark, rows), bench).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and (by[1]["n_hit"], by[1]["n_items"], by[1]["contaminated"]) == (20, 2, True)
    assert by[2]["n_hit"] == 0 and by[3]["n_hit"] == 2 and by[4]["n_words"] == 0 and by[5]["contaminated"] is False and by[None]["n_items"] == 2
    assert decontamination.report(documents(spark, []), bench).count() == 0


def test_top_k_ties_and_bad_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.5, -1.0], 1), (1, [0.5, -1.0], 1), (2, [0.5, -1.0], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (6, [], 1), (50, [-0.25, 0.5], 1)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"))
    got = sorted(tuple(r) for r in topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 2).collect())
    same = 128 * 128 + 256 * 256
    assert got == [(0, 1, 1, same), (0, 2, 2, same), (50, 1, 0, -same // 2), (50, 2, 1, -same // 2)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_top_k_large_values_and_repeated_ids(spark):
    columns = "vec_id long, embedding array<double>"
    rows = [(0, [1 / 256, 0.0]), (1, [1e15, 2.0]), (2, [-1e15, 3.0]), (3, [3.0, 1.0]), (3, [4.0, 1.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, columns))
    got = [tuple(r) for r in topk.top_k(vectors.filter("vec_id = 0"), vectors, 9).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 256 * 10 ** 15), (0, 2, 3, 1024), (0, 3, 3, 768), (0, 4, 2, -256 * 10 ** 15)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(vectors, vectors, 1).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.quantised(spark.createDataFrame([(0, [1e18])], columns)).collect()


def test_sliced_scores_are_inner_products():
    rng = np.random.default_rng(5)
    values, query = rng.integers(-300, 300, (200, 7)), rng.integers(-300, 300, 7)
    block = topk.SlicedBlock(values)
    everyone = np.zeros(block.slices.shape[2] * 64, "uint8")
    everyone[:200] = 1
    rows, score = block.top(query, np.packbits(everyone, bitorder="little").view("uint64"), 200)
    assert rows.tolist() == list(range(200)) and (score == values @ query).all()


def test_chat_roles_and_texts_come_back(spark):
    want = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").select("conv_id", "role", "text").collect()]
    got = queries.op8_chat_formatting(spark, SF).orderBy("conv_id", "turn").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in got] == want


def test_chat_edges(spark):
    lines = chat_format.as_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))
    model = chat_format.train(lines)
    rows = [(None, 0, "User: hi"), (None, 1, None), (None, 1 << 30, "Assistant: ho"), (1, 5, "no marker")]
    got = chat_format.canonical_turns(spark.createDataFrame(rows, "conv_id long, pos long, line string"), model).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["text"]) for r in got] == [(None, 0, "hi\n"), (None, 1, "ho"), (1, 0, "no marker")]
    assert [r["role"] for r in got[:2]] == ["user", "assistant"]
    assert chat_format.canonical_turns(lines.limit(0), model).count() == 0


def test_html_edges(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>Title here</h1><p>Some &amp; long text of the article.</p></article><footer>&copy; x</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_content.extract(pages).collect()}
    assert got == {1: "Title here\nSome & long text of the article.", 2: "", 3: ""}


MODEL = html_content.train()


@pytest.mark.parametrize("broken", ['<svg class="i"/>', "<svg-icon></svg-icon>", "<button-bar>", "<button>", "<object data=x/>", "<iframe src=x/>", "<select>",
                                    '<script src="x"/>', "<noscript><p>Turn it on.</p></noscript>", "<svg><svg><text>a</text></svg><text>b</text></svg>",
                                    "<button><button>go</button>", "<!-- <svg> -->", "<script>'<object>'</script>", "</root>", "</button>"])
def test_html_broken_markup_keeps_the_article(broken):
    page = f"<html><body><article><h1>Some title here</h1><p>First words of it {broken} and more of them.</p><p>The rest of the article.</p></article></body></html>"
    assert html_content.main_text(page, MODEL)[0].startswith("Some title here\nFirst words of it and more of them.\nThe rest of the article.")


def test_html_formulas_and_raw_elements():
    page = "<article><h1>A title of it</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><p>All else &lt; this.</p><SCRIPT>if (a<b) c</SCRIPT ><style>p {"
    assert html_content.main_text(page, MODEL)[0] == "A title of it\nLet x=1 hold.\nAll else < this."


@pytest.mark.parametrize("unit", ["<b>x", "<p>y", "<h1>x", "<button>", "<svg>", "</b>", "<div>", "<li>", "<b>x</i>", "<p><b>z"])
def test_html_time_follows_the_page(unit):
    seconds = []
    for n in (4_000, 16_000):
        start = time.perf_counter()
        html_content.main_text(unit * n + "<p>y" * n, MODEL)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 9 * seconds[0] + 0.2


def test_html_repeated_and_no_rows(spark):
    columns = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><h1>Title here</h1><p>Some long text of it.</p></article>"
    got = html_content.extract(spark.createDataFrame([(1, "u", page, "t", "c"), (1, "u", page, "t", "c"), (None, None, page, None, None)], columns)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(i, "Title here\nSome long text of it.", 32) for i in (0, 1, 1)]
    assert html_content.extract(spark.createDataFrame([], columns)).count() == 0


def test_html_held_out_pages():
    """Blocks of labelled pages that the model was not fitted on."""
    hit = wrong = missed = 0
    for page in html_content.labelled_pages(60, seed=11):
        tree = html_content.parse(page)
        prob, _ = html_content.marginals(tree, MODEL)
        for text, label, p in zip(tree.text, tree.label, prob):
            if text is not None:
                hit += bool(label) and p >= 0.5
                wrong += not label and p >= 0.5
                missed += bool(label) and p < 0.5
    assert hit > 200 and wrong <= 0.05 * hit and missed <= 0.05 * hit, (hit, wrong, missed)


def test_html_marginals_are_exact():
    """Sum-product against the sum over all labellings of a small tree."""
    tree = html_content.parse("<div><p>one two</p><ul><li>three</li><li><a href=x>four</a></li></ul></div><p>five.")
    n = len(tree.parent)
    weight = np.zeros(n)
    total = 0.0
    for state in range(1 << n):
        on = [(state >> i) & 1 for i in range(n)]
        w = np.prod([MODEL.odds(tree.features[i]) if on[i] else 1.0 for i in range(n)])
        w *= np.prod([MODEL.factors[tree.text[i] is not None][on[tree.parent[i]]][on[i]] for i in range(1, n)])
        total += w
        weight += w * np.array(on)
    assert np.allclose(html_content.marginals(tree, MODEL)[0], weight / total, atol=1e-9)


def test_packing_is_gapless(spark):
    rows = [(1, None), (2, ""), (3, words("p", 3000)), (3, "again"), (None, "x")]
    got = packing.pack_documents(documents(spark, rows), queries.TOKENIZER).toPandas()
    assert len(got[got.piece == 0]) == 5
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group["offset"].tolist() == [0, *group["length"].cumsum().tolist()[:-1]] and group["length"].sum() <= 4096


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.example.org/es/1"), (2, "https://x.com/fr/2?q"), (3, None), (4, "noscheme")], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_reputation.judge(pages, spark.createDataFrame([], "key long, good int")).collect()}
    assert got[1] == ("a.example.org", "example.org/es/", "block") and got[2] == ("x.com", "com/fr/", "allow") and got[3][:2] == ("", None)


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    first = spark.read.parquet(f"{SF}/documents.parquet")
    stage = corpus_pipeline.without_repeated_lines(spark, first, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    assert out.count() > 0 and stage.columns == first.columns


def test_forms_of_a_word_share_its_ids(monkeypatch):
    import public_tokenizers
    from beatwise.llm.packing import WordIds
    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = "gewohnt Gewohnt GEWOHNT, gewohnt!? Über über. naïve\nNaïve;"
    made, word = [], words.full.model.tokenize
    class Model:
        def tokenize(self, letters):
            made.append(letters)
            return word(letters)
    whole = words.encode(text)
    class Full:
        model = Model()
        encode = staticmethod(words.full.encode)
    words.full = Full()
    assert words.text(text) == whole and len(made) == len(set(made)) == 3
