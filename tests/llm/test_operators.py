"""Each operator against a brute-force version: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import bpe, chat, common, components, html_text, jaccard, mixing, neardup, pitman_yor, token_files, topk, toxicity

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997} the" for i in range(30_000))
TEXTS = [None, "", "   ", "one", "The cat sat, on the mat.", "the cat sat, on the mat.", "x  y \n\n z ", "é,   naïve 日本語 🙂🙃 it's 'quoted' 12,345", "a" * 5000, LONG, "The cat sat, on the mat."]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "clash", i) for i, t in enumerate(TEXTS)]
    rows += [(i, f"{i} " + " ".join(f"t{(i * 7 + k) % 90}" for k in range(40)), "s1", "clash", 1) for i in range(100, 160)]
    rows += [(i, "common text that many documents share word for word in this table " + f"tail{i % 5}", "s2", "clash", 1) for i in range(200, 240)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _draw int")


def test_words_and_hashes():
    texts = pa.array(["A b", None, "\x0bÉcole  B ", ""])
    words, ends = common.lower_words(texts[1:])
    assert words.to_pylist() == ["École", "b"] and ends.tolist() == [0, 0, 2, 2]
    many = [f"w{i}" for i in range(20_000)] + ["", "a\x00", "a"]
    assert len(set(common.hash_strings(pa.array(many, pa.large_string())).tolist())) == len(many)


def test_byte_bpe(docs):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True, with_offsets=True).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert bytes(r.decoded) == texts[r.doc_id].encode()
        assert not ids or r.token_ends[-1] == len(texts[r.doc_id])
    assert bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_byte_bpe_whitespace_runs():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.PieceEncoder(bpe.tokenizer_json(ranks, P.PATTERN), bpe.ByteDecoder(ranks).n)
    rng = np.random.default_rng(1)
    alphabet = ["a", "é", " ", "\n", " ", " ", "'s", ",", "1", "日", "́", "\x85", "　", "ß", "×", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, 30)) for _ in range(500)]
    ids, ends = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode_ordinary(t) for t in texts]


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    plain = Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    manifest = token_files.write(docs, spec, common.new_path(spark, "test-tokens"), end_id=2, sequence=64, parts=3)
    got = {r.doc_id: r for r in token_files.read(spark, manifest).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        found = got[r.doc_id]
        assert (found.start, found.n_tokens, found.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    tokens, mask = token_files.sequence_at(manifest[0].path, 0)
    assert len(tokens) == len(mask) == 64 and all(mask.to_pylist())
    for m in manifest:
        whole = token_files.open_stream(m.path).read_all()
        every, masks = whole.column(0).to_pylist(), whole.column(1).to_pylist()
        for i in {0, 1, token_files.BATCH, len(every) - 1} & set(range(len(every))):
            tokens, mask = token_files.sequence_at(m.path, i)
            assert tokens.tolist() == every[i] and mask.to_pylist() == masks[i]
    assert any(m.n_tokens > 64 * token_files.BATCH for m in manifest)
    assert token_files.read(spark, token_files.write(docs.limit(0), spec, common.new_path(spark, "test-tokens"), end_id=2, parts=2)).count() == 0


def test_word_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    plain = Tokenizer.from_str(spec)
    plain.encode_special_tokens = True
    rng = np.random.default_rng(5)
    alphabet = ["a", "H", "t", "T", "é", "É", "ß", "×", "÷", "İ", "ŉ", "ſ", "Ÿ", "Ł", "ǰ", "日", "Σ", "ς", "\u0301", "\u0331", "\u0307", "K"]
    alphabet += [" ", " ", "\n", "\x0b", "\x1f", "\x85", "\u00a0", "\u3000", "'s", "'LL", "'", ",", "***", "1", "٣", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "\0"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(3000)] + [t or "" for t in TEXTS] + [" ", "A", "A\u0331", "É"]
    for most in (token_files.REMEMBERED, 50):
        enc = token_files.WordEncoder(spec, most)
        for part in (texts[:7], texts[7:2000], texts[1500:], [""], texts[:40]):
            ids, ends = enc.encode(pa.array([t if t else None for t in part], pa.string()))
            assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in part]
    assert isinstance(token_files.encoder(spec), token_files.WordEncoder)
    assert not isinstance(token_files.encoder(spec.replace('"Lowercase"', '"NFKC"')), token_files.WordEncoder)


def test_words_in_use_are_encoded_once():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        enc = token_files.WordEncoder(f.read(), 1000)
    often, met = " ".join("often" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(300)), []
    learn = enc._learn
    enc._learn = lambda pieces: (met.extend(pieces), learn(pieces))
    for k in range(30):
        seldom = " ".join("".join(chr(97 + int(d)) for d in str(1000 * k + i)) + "x" for i in range(100))
        enc.encode(pa.array([f"{often}\n{seldom}", often.upper()]))
        assert len(enc.known) <= 1000
    assert sum(p.startswith("often") for p in met) == 300


def test_mixing(spark, docs):
    rows = mixing.mix_sizes(docs).collect()
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    total = Counter()
    for i, s in source.items():
        total[s] += sizes[i]
    order = sorted((s for s in total if s is not None)) + [None]
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        biggest = max(sizes[i] for i in sizes if source[i] == s)
        assert abs(taken[s] - target[s]) <= biggest / 2 + 1
    again = {r.doc_id: r.taken for r in mixing.mix_sizes(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r.doc_id for r in mixed.collect())
    assert all(counts[r.doc_id] * r["size"] == r.taken for r in rows)
    assert mixing.mix_sizes(docs.limit(0)).count() == 0


def brute_components(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, docs, n, percent):
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(300, 380):  # one large group of near copies, each with a few words changed
        words = list(base)
        for k in rng.choice(120, rng.integers(0, 4), replace=False):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, size string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(table, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "A B\tc"), (8, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_documents(rows).collect())
    assert got == [("5", 1, "5"), ("5", 1, "5"), ("7", 1, "5"), ("8", 0, "8"), ("None", 1, "None")]
    kept = jaccard.keep_one(rows.where("doc_id > 5 or doc_id is null").unionByName(spark.createDataFrame([(1, "a b c")], rows.schema)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "8"]
    odd = spark.createDataFrame([(1, "a b c", 0), (1, "x y z", 1), (1, "x y z", 2), (None, "p q r", 3), (None, "p q r", 4), (2, "a b c", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, row int")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(odd).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(2, "a b c"), (1, "x y z"), (None, "p q r"), (None, None), (3, "")]))


def thue_morse(n: int = 10) -> list[str]:
    """Two words of 2**n letters that power series modulo 2**64 can't tell apart."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_words_that_power_series_confuse(spark):
    import tiktoken
    from tokenizers import Tokenizer

    words = thue_morse()
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:2]
    table = spark.createDataFrame(list(zip(train, words, strict=True)), "doc_id long, text string").coalesce(1)
    assert len(set(common.hash_strings(pa.array(words)).tolist())) == 2
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_decode(table, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()}
    assert all(got[i].ids == plain.encode_ordinary(w) and got[i].decoded_sha256 == hashlib.sha256(w.encode()).hexdigest() for i, w in zip(train, words, strict=True))
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    files = token_files.read(spark, token_files.write(table, spec, common.new_path(spark, "test-tokens"), end_id=2, parts=1)).collect()
    ids = {i: Tokenizer.from_str(spec).encode(w, add_special_tokens=False).ids + [2] for i, w in zip(train, words, strict=True)}
    assert {r.doc_id: r.ids_crc32 for r in files} == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    assert {r.component_id for r in jaccard.similar_documents(table).collect()} == set(train)
    for r in pitman_yor.score_documents(table).collect():  # two words and their ends: 4 tokens of 3 kinds
        assert r.base_score == pytest.approx(math.log10(1.1 / 4.4) + math.log10(2.1 / 4.4))
    columns = toxicity.word_columns(pa.array(words, pa.large_string()))
    assert columns[0, 0] != columns[1, 0]


def test_extra_columns_with_inner_names(spark):
    """Values, not only names, of columns called like what the operators use inside."""
    names = ["target", "source_size", "_draw", "_size", "_slot", "_times", "_row", "_severity", "_p_toxic", "_marks", "row", "marks", "id", "_id", "_gone", "_shared", "_c", "_i", "size"]
    rows = [(i, f"word{i} " * 5 + f"idiot{i % 2}", "s", *range(i, i + len(names))) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    want = {r[0]: r for r in rows}
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for after in (mixing.mix_documents(table), toxicity.keep_clean(table, labels), jaccard.keep_one(table)):
        assert after.columns == table.columns
        got = [tuple(r) for r in after.collect()]
        assert got and all(r == want[r[0]] for r in got)
    scored = toxicity.score(table, toxicity.train(table, labels))
    assert scored.columns.count("_severity") == 1 and scored.count() == 12


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 8), *[(100, 100 + k) for k in range(1, 50)], (149, 7)]
    got = {r.node: r.component_id for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 8, 20: 8, **{100 + k: 7 for k in range(50)}}


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], "c") for i in range(400)]
    rows += [(500, rows[0][1], "c"), (600, rows[100][1], "c"), (1000, None, "c"), (1100, [1.0, None] * 4, "c"), (1200, [float("nan")] * 8, "c"), (1300, [float("inf")] * 8, "c"), (1400, [0.0] * 8, "c"), (None, rows[0][1], "c"), (1500, [2.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    vectors = topk.integers(table)
    got = defaultdict(list)
    for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    held = {r.vec_id: r.v for r in vectors.collect()}
    for q in (i for i in held if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_topk_bounds_agree_at_every_depth(monkeypatch):
    rng = np.random.default_rng(3)
    x, q = rng.integers(-500, 500, (2000, 16)), rng.integers(-500, 500, (40, 16))
    q[:20] = x[:20] * 3  # queries whose best are far ahead stop early
    ids, q_ids = np.arange(2000), np.arange(5000, 5040)
    want = [np.lexsort((ids, -(x @ row)))[:5].tolist() for row in q]
    for depths in ((1.0,), (0.1, 0.3, 0.5, 0.9, 1.0), (0.5, 1.0)):
        monkeypatch.setattr(topk, "DEPTHS", depths)
        rows, found, score, read = topk.search_block(q, q_ids, x, ids, 5)
        assert (read[:20] < 1).any() == (depths[0] < 1) and (read[read < 1] >= depths[0]).all()
        assert [found[rows == i].tolist() for i in range(40)] == want
        assert (score == (q[rows] * x[found]).sum(axis=1)).all()


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=32)]) for i in range(150)]
    centre = rng.normal(size=32)
    for i in range(200, 320):
        rows.append((i, [float(v) for v in centre + rng.normal(size=32) * 0.05]))
    rows += [(400 + i, rows[3][1]) for i in range(5)] + [(410, [2 * v for v in rows[4][1]])]
    rows += [(500, None), (501, [0.0] * 32), (502, [float("nan")] * 32), (503, []), (504, [1.0, 2.0])]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 32 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    alike = np.array([good[i] for i in ids]) @ np.array([good[i] for i in ids]).T >= 0.95
    links = {i: int(alike[k].sum()) - 1 for k, i in enumerate(ids)}
    assert sum(got[i].n_links for i in ids) >= 0.98 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in ids)
    assert got[403].component_id == 3 and not got[403].kept and got[410].component_id == 4 and got[319].component_id == 200
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (500, 501, 502, 503, 504))
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_collision_recall():
    """Pairs at the very threshold are found with the recall that the count is set for."""
    rng = np.random.default_rng(6)
    a = neardup.unit(rng.normal(size=(400, 64)))
    other = rng.normal(size=(400, 64))
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.9501 * a + math.sqrt(1 - 0.9501**2) * neardup.unit(other)
    found = {i: set(j.tolist()) for i, j in neardup.links_in(a, b, False, 0.95)}
    assert sum(i in found.get(i, ()) for i in range(400)) >= 0.97 * 400


def test_chat(spark):
    rows = [(1, 0, "user", "<|end|><<>"), (1, 1, "user", None), (1, None, "user", "<|text|>a"), (1, 2, "assistant", "<"), (1, 700, "assistant", "b"), (1, 700, "assistant", "b"), (None, 3, None, "z"), (2, 0, "assistant", ""), (3, 1, "assistant", "x" * 100_000)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    for key, r in got.items():
        want = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == key), key=lambda x: x)
        assert [(t.role, t.text) for t in r.turns] == [(a, b) for *_, a, b in want]
        assert r.loss_text == "".join(b for *_, a, b in want if a == "assistant")
    assert got[1].formatted.count(chat.ROLE) == 2
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_html(spark):
    noise = "<nav><ul><li><a href=/x>Menu &amp; more</a></ul></nav>"
    page = lambda k: f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{noise}<div class='sidebar-2'>side text that is long enough to matter</div><div id=main><div class='post post-{k}'><h1>Title {k}</h1><p>First&nbsp;para <b>bo</b>ld &lt;x&gt;<br>next<p>Second\n para<script>var a='</p>';</script><form>no</form><div class=comments><p>bad reader words</p></div></div></div><footer>&copy;</footer>"
    rows = [(k, f"http://h.example/{k}", page(k), "c") for k in range(5)]
    rows += [(10, None, None, "c"), (11, "http://h.example/e", "", "c"), (12, "nonsense", "just <i>te</i>xt", "c"), (13, "http://h.example/x", "<html><body><article>other <p>layout</article>", "c"), (14, "http://h.example/l", "<html><body><div class='post'>" + "<p>word " * 20_000, "c")]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3].text == "Title 3 First para bold <x> next Second para" and got[3].n_chars == len(got[3].text)
    assert got[10].text == got[11].text == "" and got[12].text == "just text" and got[13].text == "other layout"
    assert got[14].text == " ".join(["word"] * 20_000)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_decoding_nesting_and_raw_elements():
    body = "<p>AT&<b>amp;</b>T &amp;lt; x</p><svg width=1/><p>formula <math><mi>x</mi></math></p><object data=a><p>inside</p></object>" + "more words here " * 20
    page = f"<html><body><article>{body}</article></body></html>"
    text = html_text.extract(page, html_text.vote(page)[0])
    assert text.startswith("AT&amp;T &lt; x formula x inside more words") and text.count("more words here") == 20
    deep = "<html><body>" + "<div class=menu-x id=b1>" * 20_000 + "<p>deep text</p>" + "</div>" * 20_000
    assert html_text.extract(deep, html_text.vote(deep)[0]) == "deep text"


def test_html_against_a_real_parser(spark):
    """The pages' articles as html.parser reads them: all text in article but for elements marked ad."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        void = frozenset("area base br col embed hr img input link meta source track wbr".split())
        inline = html_text.INLINE

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open, self.text = [], []

        def inside(self):
            marks = [m for _, m in self.open]
            return "article" in marks and "no" not in marks

        def handle_starttag(self, tag, attrs):
            kind = dict(attrs).get("class") or ""
            if tag not in self.inline:
                self.text.append(" ")
            if tag not in self.void:
                gone = kind in html_text.DROPPED_WORDS or tag in ("nav", "footer", "aside", "form", "script", "style", "title")
                self.open.append((tag, "no" if gone else "article" if tag == "article" else ""))

        def handle_endtag(self, tag):
            if tag not in self.inline:
                self.text.append(" ")
            while any(t == tag for t, _ in self.open):
                if self.open.pop()[0] == tag:
                    break

        def handle_data(self, data):
            if self.inside():
                self.text.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    with_article = {r.page_id: r.html for r in pages.where("html like '%<article%'").collect()}
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    assert len(with_article) > 10
    for page_id, page in with_article.items():
        reader = Article()
        reader.feed(page)
        assert got[page_id].text == " ".join("".join(reader.text).split())


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    bad = ["idiot", "moron", "scum", "loser"]
    rows, labels = [], []
    for i in range(900):
        words = [f"w{k}" for k in rng.integers(0, 500, 60)]
        toxic = i % 5 == 0
        if toxic:
            for k in rng.choice(60, rng.integers(2, 9), replace=False):
                words[k] = bad[k % 4] + ("," if k % 3 else "")
        rows.append((i, " ".join(words), toxic))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None, False), (1001, "", False), (1002, "idiot " * 50_000, True)], "doc_id long, text string, severity boolean")
    known = spark.createDataFrame([x for x in labels if x[0] < 600] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    assert (np.diff(model.cuts) >= 0).all() and len(model.cuts) == 3
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if 600 <= r.doc_id < 1000 or r.doc_id >= 1000]
    wrong = [r.doc_id for r in held if (r._severity >= toxicity.TOXIC_FROM) != r.severity]
    assert len(wrong) <= 0.02 * len(held)
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score(docs, toxicity.train(docs, known.limit(0))).where("_severity > 0").count() == 0
    assert toxicity.keep_clean(docs.limit(0), known).count() == 0


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div id="page" class="site no-sidebar"', 'div class="layout with-nav"', 'section class="related-work"', 'div class="widget"'])
def test_named_wrappers_keep_the_article(wrapper):
    article = '<header class="entry-header"><h1>Title</h1></header><p>' + "article text " * 30 + "</p>"
    page = f'<body><div class="ad">buy this</div><{wrapper}>{article}</{wrapper.split()[0]}></body>'
    text = html_text.extract(page, html_text.vote(page)[0])
    assert "article text" in text and "buy" not in text
    page = f"<body><article>{article}</article></body>"
    assert html_text.extract(page, html_text.vote(page)[0]).startswith("Title article text")


@pytest.mark.parametrize("form", ["<article><h1>{t}</h1><p>intro</p><section>{x}</section><p>outro</p></article>", "<div class=post><h1>{t}</h1>intro<div class=body><p>{x}</div>outro</div>", "<article><div class=lead>{t} intro</div><div class=part>{x}</div><div class=end>outro</div></article>"])
def test_text_around_the_best_container(spark, form):
    links = "<div>" + "<a href=/x>elsewhere on this site</a> " * 40 + "</div>"
    rows = [(k, "http://h.example/x", "<html><body>" + links + form.format(t=f"Title {k}", x="long " * 60) + links + "</body></html>") for k in range(3)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Title {k} intro {'long ' * 60}outro" for k in range(3)}


def test_language_model(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    texts = {i: WORD.findall(lower(t)) + ["\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r.score < 0
    test = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert pitman_yor.score_documents(docs.limit(0)).count() == 0
    alone = pitman_yor.score_documents(spark.createDataFrame([(None, "a b", 1)], "doc_id long, text string, score int")).collect()
    assert alone[0].doc_id is None and alone[0].held_out and alone[0].n_known == 0


def test_language_model_knows_contexts_of_rare_words(spark):
    # a and b are rare, x and y are as frequent: only the context tells which of them follows
    filler = " ".join(f"f{i % 50}" for i in range(1000))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    rows = [(i, f"{filler} {'a x' if k % 2 else 'b y'}" if k < 8 else filler) for k, i in enumerate(ids)]
    test = [i for i in range(400, 600) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    got = {r.doc_id: r for r in pitman_yor.score_documents(spark.createDataFrame([*rows, (test[0], "a x"), (test[1], "a y")], "doc_id long, text string")).collect()}
    assert got[test[0]].base_score == pytest.approx(got[test[1]].base_score)
    assert got[test[0]].score > got[test[1]].score + 1


def test_cells_of_slices_are_summed():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "B", "b", "cc", "longer-than-eight", "é"], rng.integers(0, 9))) for _ in range(300)]
    names = {int(h): w for w, h in zip(["a", "b", "cc", "longer-than-eight", "é"], common.hash_strings(pa.array(["a", "b", "cc", "longer-than-eight", "é"])), strict=True)}
    names |= {int(pitman_yor.END): "</s>", int(pitman_yor.BEGIN): "<s>"}
    want, lists, train = Counter(), [], rng.random(300) < 0.7
    for k in range(0, 300, 60):
        lists.append(pitman_yor.counted(*pitman_yor.tokens_of(pa.record_batch({"doc_id": list(range(60)), "text": texts[k : k + 60]})), train[k : k + 60]))
    for t, own in zip(texts, train, strict=True):
        words = ["<s>", *lower(t).split(), "</s>"]
        for cell in zip(words, words[1:], strict=False):
            want[cell] += int(own)
    large = [x._replace(counts=x.counts.astype(np.int64) << 58) for x in lists[:1]]  # beyond what is sorted as one number
    for got, expected in ((pitman_yor.merged(lists), want), (pitman_yor.merged([pitman_yor.merged(lists[:2]), *lists[2:]]), want), (pitman_yor.merged(large), None)):
        order = list(zip(got.contexts[got.c].tolist(), got.words[got.w].tolist(), strict=True))
        assert order == sorted(set(order)) and set(got.c) == set(range(len(got.contexts))) and set(got.w) == set(range(len(got.words)))
        cells = {(names[c], names[w]): n for (c, w), n in zip(order, got.counts.tolist(), strict=True)}
        assert cells == (expected if expected is not None else {k: n << 58 for k, n in zip(cells, pitman_yor.merged(lists[:1]).counts.tolist(), strict=True)})
    assert len(pitman_yor.merged([]).c) == 0
    numbers = rng.integers(0, 50, 200)
    for x in (numbers, numbers << 56, numbers[:0]):
        assert all((a == b).all() for a, b in zip(pitman_yor.distinct(x), np.unique(x, return_inverse=True), strict=True))


def test_lookup_scores_each_word_once(monkeypatch):
    """The words' base scores are computed a shard, not a slice of texts, at a time."""
    cells = {"contexts": np.array([5], np.uint64), "spans": np.array([3], np.uint32), "words": np.array([1, 2, 9], np.uint64), "dishes": np.array([0, 1, 2], np.uint32), "counts": np.array([4, 0, 7], np.uint32)}
    scores = {"scores": np.array([-1, -2, -3], np.float32), "word_counts": np.array([4, 0, 7], np.uint32)}
    files = type("Files", (), {"read": lambda self, key: cells if key.startswith("cells") else scores})()
    keys, calls = pitman_yor.cell_keys(np.full(3, 5, np.uint64), cells["words"]), []
    base = pitman_yor.Words.base
    monkeypatch.setattr(pitman_yor.Words, "base", lambda self, counts: (calls.append(len(counts)), base(self, counts))[1])
    rows = [b for k in range(20) for b in pitman_yor.keyed(k, keys, np.zeros(3, np.int64), np.array([2, 0, 0, 1]), np.array([0, 0, 0, 1]))]
    model = pitman_yor.Model(pitman_yor.Words(11, 2), 0.5)
    got = list(pitman_yor.looked_up(pa.Table.from_batches(rows), files, model))
    assert len(got) == 20 and sum(calls) <= 3
    b = base(model.words, np.array([4, 0, 7]))
    for r in got:
        assert np.frombuffer(r["known"], np.int32).tolist() == [3, 0]
        assert np.frombuffer(r["score"]).tolist() == [-5.0, -2.0]
        assert np.frombuffer(r["base"]) == pytest.approx([2 * b[0] + b[2], b[1]])


def test_restaurants_sum_to_one():
    rng = np.random.default_rng(8)
    words = 30
    cells = np.unique(rng.integers(0, 5, 400) << 16 | rng.integers(0, words, 400))
    r = pitman_yor.Restaurants(cells, rng.integers(1, 60, len(cells)).astype(np.uint32), 0, 0.7)
    root = np.full(words, 1 / words)
    *_, (tables, opened) = r.chain([root] * 3)
    assert (tables >= 1).all() and (tables <= r.counts).all()
    after = pitman_yor.reseat_root(np.bincount(r.dish, weights=tables, minlength=words).astype(np.int64), 0.7, 0)
    assert after.sum() == pytest.approx(1)
    p, back = r.predict(root, tables, opened, after)
    for k in range(len(r.first)):
        own = r.of == k
        assert p[own].sum() + back[k] * (1 - after[r.dish[own]].sum()) == pytest.approx(1)
    *_, (again, _) = r.chain([root] * 3)
    assert (again == tables).all()


def test_seating_follows_the_exact_distribution():
    """Tables of two dishes in one restaurant against all their seatings, weighed by brute force."""
    d, parent, customers = 0.6, np.array([0.2, 0.05]), (6, 3)
    stirling = pitman_yor.log_stirling(d)
    weight = {}
    for t, u in [(t, u) for t in range(1, 7) for u in range(1, 4)]:
        opened = math.prod(pitman_yor.STRENGTH + d * i for i in range(t + u))
        weight[t, u] = math.exp(stirling[6, t] + stirling[3, u]) * opened * parent[0] ** t * parent[1] ** u
    # Stirling numbers by seating six customers in every way
    ways = Counter({(): 1.0})
    for _ in range(6):
        more = Counter()
        for sizes, w in ways.items():
            more[(*sizes, 1)] += w
            for i, n in enumerate(sizes):
                more[(*sizes[:i], n + 1, *sizes[i + 1 :])] += w * (n - d)
        ways = more
    for t in range(1, 7):
        assert math.exp(stirling[6, t]) == pytest.approx(sum(w for sizes, w in ways.items() if len(sizes) == t))
    many = 20_000
    keys = np.repeat(np.arange(many), 2) << 16 | np.tile([0, 1], many)
    r = pitman_yor.Restaurants(keys, np.tile(customers, many).astype(np.uint32), 0, d)
    *_, (tables, _) = r.chain([parent] * 6)
    got = Counter(map(tuple, tables.reshape(-1, 2).tolist()))
    for pair, w in weight.items():
        assert got[pair] / many == pytest.approx(w / sum(weight.values()), abs=0.012)


def test_queries_give_their_columns(spark):
    import __spark_entry__ as entry

    want = {"op2": "conv_id n_turns turns_sha256", "op3": "doc_id n_tokens ids_sha256 decoded_sha256", "op5": "doc_id start n_tokens ids_crc32", "op9": "doc_id size source_size target taken", "op10": "doc_id n_shingles component_id"}
    found = entry.queries()
    for n, columns in want.items():
        name = next(q for q in found if q.startswith(n + "_"))
        df = found[name](spark, "/root/testdata/sf0.001")
        assert set(columns.split()) <= set(df.columns) and df.count() > 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, kept, at), "test-stage")
        assert after.columns == docs.columns, name
        if name == "toxicity":
            assert 0.8 * kept.count() <= after.count() < kept.count()
        if name == "near_copies":
            want = brute_components([(r.doc_id, r.text) for r in kept.collect()], 5, 80)
            assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in want.items() if i == c}
        kept = after
    assert corpus_pipeline.STAGES[-1][1](spark, kept, at).where(F.size("ids") != F.col("n_tokens")).count() == 0
