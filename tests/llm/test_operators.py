"""The corpus operators against brute force on a small fixture with nulls, empty and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, common as C, extraction, language, merkle, neardup, packing, pieces, quality, sharding, suffixtree, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("aeinorstéÀ") for _ in range(r.randrange(1, 9))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) + r.choice(["", "", ".", ",", "!"]) + ("\n" if r.random() < 0.08 else "") for _ in range(r.randrange(8, 160))) for _ in range(60)]
    near = []
    for t in base[:14]:
        for _ in range(3):
            w = t.split(" ")
            w[r.randrange(len(w))] = r.choice(vocabulary)
            near.append(" ".join(w))
    odd = [None, "", "  \n\t ", "one", "two words", "Same line\nSame line\n\nSame line\nother", "x" * 5000, "don't I'LL 123 $$ # | <b>", "中文 🙂 Ω é", "<|endoftext|> a", "▁a  b", base[0], base[0].upper(), base[1], "a b c d e a b c d e a b c d e", "\x00\x1c", "tab\tsep\vvt\fff\rcr"]
    return [*base, *near, *odd]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "ab"[i % 2] if i % 5 else None, "s", 0) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("score", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("kept", F.lit(0)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_quality(docs, none):
    got = rows(quality.repetition_rules(docs))
    for i, t in enumerate(texts()):
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, (i, t)
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        assert g.base_failed == failed and (not g.kept or not failed)
    assert quality.repetition_rules(none).count() == 0
    assert "source" in quality.repetition_rules(docs).columns


def test_tokens():
    e = tokens.WordEncoder(tokens.path_of())
    for t in texts():
        assert e.encode(t).tolist() == e.library.encode(t or "", add_special_tokens=False).ids


def test_pieces(docs, none):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.PIECE_BPE))
    got = rows(pieces.piece_round_trip(docs))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))), t
    assert pieces.piece_round_trip(none).count() == 0


def test_packing(docs, none):
    lib = tokens.WordEncoder(tokens.path_of())
    got = packing.pattern_pack(docs, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for x in by.values():
        x.sort(key=lambda r: r.offset)
        assert [r.offset for r in x] == np.cumsum([0, *[r.length for r in x]])[:-1].tolist() and sum(r.length for r in x) <= 64
    mine = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got}
    want = {}
    for i, t in enumerate(texts()):
        ids = [*lib.encode(t).tolist(), 0]
        for j in range(0, len(ids), 64):
            want[i, j // 64] = (j, len(ids[j : j + 64]), crc(ids[j : j + 64]))
    assert mine == want and len(got) == len(want)
    assert len(by) <= 1.1 * sum(v[1] for v in want.values()) / 64 + 1
    assert packing.pattern_pack(none).count() == 0


def test_plan():
    """Patterns place the bulk, and the sequences are hardly more than with best fit alone, or than the tokens need."""
    r = random.Random(1)
    dense = collections.Counter(min(2048, max(1, int(r.lognormvariate(6.4, 0.8)))) for _ in range(20_000))
    for counts in (dense, *({r.randrange(1, 2049): r.randrange(1, 400) for _ in range(300)} for _ in range(4))):
        kinds, placed = packing.pattern_plan(counts)
        back = collections.Counter()
        for kind, n in kinds:
            assert sum(kind) <= 2048
            for k in kind:
                back[k] += n
        assert back == collections.Counter(counts)
        alone = sum(n for _, n in packing.plan_sequences(counts, slacks=()))
        assert sum(n for _, n in kinds) <= 1.02 * alone + 2
        assert placed >= 0.6 * sum(v for k, v in counts.items() if k < 2048)
    kinds, placed = packing.pattern_plan(dense)
    assert sum(n for _, n in kinds) <= 1.003 * sum(k * v for k, v in dense.items()) / 2048 + 1 and placed >= 0.7 * sum(dense.values())
    assert packing.pattern_plan({}) == ([], 0) and packing.pattern_plan({2048: 3})[0] == [((2048,), 3)]


def test_fit_counts():
    """The fit of a histogram that patterns can make leaves nothing, uses no more patterns than bins, and is never below zero."""
    patterns = packing.length_patterns(12)
    r = np.random.default_rng(5)
    for _ in range(5):
        made = np.bincount(patterns[r.integers(0, len(patterns), 40)].ravel(), minlength=13)
        made[0] = 0
        x = packing.fit_counts(patterns, made)
        again = np.bincount(patterns.ravel(), np.repeat(x, 3), 13)
        assert np.allclose(again[1:], made[1:], atol=1e-3) and (x >= 0).all() and (x > 0).sum() <= 13


def test_codes(spark, docs, none):
    path = C.new_path(spark, "codes")
    codes.write_codes(docs, path, block_ids=500)
    got, lib, start = rows(codes.read_codes(spark, path)), tokens.WordEncoder(tokens.path_of()), 0
    for i, t in enumerate(texts()):
        ids = [*lib.encode(t).tolist(), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    path = C.new_path(spark, "codes")
    codes.write_codes(none, path)
    assert codes.read_codes(spark, path).count() == 0
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    block = codes.Block(codes.encode_block(ids, np.array([0, 10, 5000])))
    assert (block.all() == ids).all() and [block.get(k) for k in range(0, 5000, 7)] == ids[::7].tolist() and block.document(0).tolist() == ids[:10].tolist()
    assert all((block.span(a, b) == ids[a:b]).all() for a, b in ((0, 0), (3, 3), (7, 1300), (511, 514), (4999, 5000)))
    whole, ids, at = block.document(1), np.zeros(0, np.uint32), 0
    path = C.new_path(spark, "codes")
    codes.write_codes(docs.repartition(5), path, block_ids=50)
    table = spark.read.parquet(path)
    starts = {(r.part, r.place): r.before for r in codes.block_starts(table).collect()}
    for r in table.select("part", "place", "n_ids").orderBy("part", "place").collect():
        assert starts[r.part, r.place] == at
        at += r.n_ids
    assert len(starts) > 10 and len(whole) == 4990


def test_sharding(docs, none):
    got = sharding.jump_shards(docs).collect()
    slots = collections.defaultdict(list)
    for r in got:
        t = texts()[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(texts())
    assert sharding.jump_shards(none).count() == 0


def test_jump_by_hand(docs):
    """Every shard against the jump loop in plain Python."""
    draw = lambda key, i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:8], 16) + 1) / (1 << 32)

    def shard(key, n):
        at, i = 0, 1
        while (land := int((at + 1) / draw(key, i))) < n:
            at, i = land, i + 1
        return at

    for r in sharding.jump_shards(docs).collect():
        assert (r.shard, r.grown_shard) == (shard(r.doc_id, 8), shard(r.doc_id, 9))
    few, many = ({(r.doc_id, r.slot, r.shard) for r in sharding.jump_shards(docs, rows_a_group=n).collect()} for n in (1, 20_000))
    assert few == many


def test_jump_balance(spark):
    df = spark.range(20000).select(*[sharding.jump_hash(F.col("id"), n).alias(f"n{n}") for n in (1, 5, 6)])
    assert df.where("n1 <> 0").count() == 0 and df.where("n6 <> n5 and n6 <> 5").count() == 0
    counts = [r["count"] for r in df.groupBy("n6").count().collect()]
    assert len(counts) == 6 and max(counts) < 1.1 * 20000 / 6


def test_merkle(docs, none, spark):
    got, t = rows(merkle.merkle_fingerprints(docs)), [x or "" for x in texts()]
    for i, text in enumerate(t):
        after, half = t[i - 1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[len(t) - 6].fingerprint == got[0].fingerprint if t[len(t) - 6] == t[0] else True
    assert len({(a, got[i].fingerprint) for i, a in enumerate(t)}) == len(set(t)) == len({got[i].fingerprint for i in range(len(t))})
    assert merkle.merkle_fingerprints(none).count() == 0
    a, b = "p one.\n\nsame here.\n\nlast", "p one.\n\nsame here.\n\nother"
    df = spark.createDataFrame([(a, b)], "a string, b string").select(*[merkle.sections(merkle.tree(F.col(c))).alias(c) for c in "ab"], F.col("a").alias("x"), F.col("b").alias("y"))
    df = df.select("a", "b", merkle.fingerprint(F.col("x"), F.col("a")).alias("fa"), merkle.fingerprint(F.col("y"), F.col("b")).alias("fb"))
    got = df.select(merkle.differing(F.col("a"), F.col("b")).alias("d"), merkle.differing_sections(F.col("fa"), F.col("fb")).alias("e"), F.size("a").alias("n")).first()
    assert got.d == got.e == [got.n - 1]


def test_merkle_names(docs, spark):
    """doc_ids of any type: the same texts under names that order alike have the same fingerprints."""
    plain = rows(merkle.merkle_fingerprints(docs))
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))
    for r in merkle.merkle_fingerprints(named).collect():
        assert r[1:] == plain[int(r.doc_id[1:])][1:]


def test_language(docs, none, spark):
    r = random.Random(3)
    make = lambda syl: " ".join("".join(r.choice(syl) for _ in range(r.randrange(1, 4))) for _ in range(80))
    both = {"xa": ["th", "er", "on", "an"], "yb": ["ção", "lh", "os", "ei"]}
    data = [(i, make(both[k]), k) for i, k in enumerate(["xa", "yb"] * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(df.where("doc_id < 60"))
    got = rows(language.identify_language(df.where("doc_id >= 60"), profiles))
    assert all(g.lang_pred == g.lang for g in got.values())
    grams = collections.Counter()
    for i, t, k in data[:60]:
        if k == "xa":
            for w in t.split():
                for n in (1, 2, 3):
                    padded = w if n == 1 else f" {w} "
                    grams.update((n, padded[j : j + n]) for j in range(len(padded) - n + 1))
    code = lambda n, g: (sum((0 if c == " " else ord(c)) << 16 * (n - 1 - j) for j, c in enumerate(g)) << 2) | n
    want = sorted(((-v, code(n, g)) for (n, g), v in grams.items()))[:300]
    assert profiles["xa"] == [c for _, c in want]
    plain = rows(language.identify_language(docs, profiles))
    assert [plain[i].lang_pred for i, t in enumerate(texts()) if t is None or not any(c.isalpha() for c in t)] == ["und"] * sum(t is None or not any(c.isalpha() for c in t) for t in texts())
    assert rows(language.identify_language(df.limit(1), {}))[0].lang_pred == "und"
    assert language.identify_language(none, profiles).count() == 0


def test_language_by_hand(docs, spark):
    """Every prediction and score against out-of-place distances in plain Python."""
    import unicodedata

    def profile(t):
        low = lambda c: (c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " "
        words, grams = "".join(map(low, t or "")).split(" "), collections.Counter()
        for w in words:
            if w:
                for n in (1, 2, 3):
                    padded = w if n == 1 else f" {w} "
                    grams.update(padded[j : j + n] for j in range(len(padded) - n + 1) if padded[j : j + n].strip())
        points = lambda c: 0 if c == " " else min(ord(c), 0xFFFE)
        code = lambda g: (sum(points(c) << 16 * (len(g) - 1 - j) for j, c in enumerate(g)) << 2) | len(g)
        return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[:300]]

    profiles = {"b": profile(" ".join(texts()[k] for k in range(30))), "a": profile(" ".join(texts()[k] for k in range(30, 60)))[:200]}
    got = rows(language.identify_language(docs, profiles))
    for i, t in enumerate(texts()):
        mine = profile(t)
        far = {k: sum(abs(p.index(g) - r) if g in p else 300 for r, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        want = (best, 1 - far[best] / (300 * len(mine))) if mine else ("und", 0.0)
        assert (got[i].lang_pred, got[i].score) == (want[0], pytest.approx(want[1])), i


def test_extraction(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/x'>menu</a></nav><div class=\"ad\">buy</div><article><h1>Head &amp; line</h1><p><b>One\n two.<br><p>Three <i>four</i>.</p><aside>no</aside><script>var t='</p>';</script></article><div id='comments'>talk</div><footer>&copy; x</footer>"
    shared = "shared boiler plate text that every page of the host shows at its end today"
    loose = [(k, f"http://h.example/{k}", f"<body><p>{' '.join(f'w{k}x{j}' for j in range(30))}</p><p>{shared}</p></body>") for k in range(2, 8)]
    df = spark.createDataFrame([(0, "http://a.example/1", page), (1, None, None), *loose, (9, "x", ""), (9, "x", "")], "page_id long, url string, html string")
    got = collections.defaultdict(list)
    for r in extraction.extract_main_text(df).collect():
        got[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    assert got[0][0].text == "Head & line\nOne two.\nThree four." and got[1][0].text == "" and len(got[9]) == 2
    assert all(got[k][0].text == " ".join(f"w{k}x{j}" for j in range(30)) for k in range(2, 8))
    assert extraction.extract_main_text(df.limit(0)).count() == 0


def test_extraction_over_groups(spark):
    """A host's boilerplate is found in whatever groups its pages meet, and copies of a page are one page."""
    line = lambda k, n=20: " ".join(f"{k}x{j}" for j in range(n))
    page = lambda k, *more: f"<body><p>{line(k)}</p>{''.join(f'<p>{m}</p>' for m in more)}</body>"
    notice, rare = line("notice", 12), line("rare", 12)
    html = {k: page(f"w{k}", *([notice] if k % 40 == 0 else []), *([rare] if k in (1, 2) else [])) for k in range(400)}
    html |= {k: page("copy") for k in range(400, 406)}
    df = spark.createDataFrame([(k, f"http://h.example/{k}", h) for k, h in html.items()], "page_id long, url string, html string")
    want = {k: line(f"w{k}") + (f"\n{rare}" if k in (1, 2) else "") for k in range(400)} | {k: line("copy") for k in range(400, 406)}
    for size in (2000, 20_000, 1 << 23):
        assert {r.page_id: r.text for r in extraction.extract_main_text(df, size).collect()} == want, size


def brute_extraction(pages):
    """The same rules with sets of token windows."""
    parsed = {k: (re.sub(r"^\w+://([^/?#]*).*|.*", r"\1", u or "").lower(), extraction.parse_blocks(h)) for k, (u, h) in pages.items()}
    may = {k: [j for j, (p, _) in enumerate(b) if (p & 3 == 2 if any(q & 3 == 2 for q, _ in b) else p == 1)] for k, (_, b) in parsed.items()}
    article = {k: "\n".join(b[j][1] for j in may[k]) for k, (_, b) in parsed.items()}
    seen, stream = collections.defaultdict(set), {}
    for k, (host, b) in parsed.items():
        stream[k] = [(j, w) for j, (_, t) in enumerate(b) for w in WORD.findall(t)]
        for a in range(len(stream[k]) - 7):
            seen[host, tuple(w for _, w in stream[k][a : a + 8])].add(article[k])
    out = {}
    for k, (host, b) in parsed.items():
        share = {}
        for least in (2, 3):
            hit = set()
            for a in range(len(stream[k]) - 7):
                if len(seen[host, tuple(w for _, w in stream[k][a : a + 8])]) >= least:
                    hit.update(range(a, a + 8))
            share[least] = collections.Counter(stream[k][a][0] for a in hit)
        size = collections.Counter(j for j, _ in stream[k])
        stay = [j for j in may[k] if share[2 if b[j][0] & 4 else 3][j] <= 0.6 * size[j]]
        main = any(p & 3 == 2 for p, _ in b)
        if main and sum(share[3][j] for j in may[k]) > 0.5 * sum(size[j] for j in may[k]) or not stay:
            stay = may[k]
        out[k] = "\n".join(b[j][1] for j in stay)
    return out


def test_extraction_by_hand(spark):
    """Articles with notices, copies, near copies, class names, on hosts of any size; 4 pages of many behave as 4 of few."""
    r = random.Random(7)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n))
    notices, pages = [say(11) for _ in range(4)], {}
    for k in range(160):
        body = [f"<h1>{say(4)}</h1>", *(f"<p>{say(r.randrange(3, 40))}</p>" for _ in range(4))]
        if k % 40 < 4:
            body.insert(r.randrange(1, 5), f"<p class='notice'>{notices[k % 2]}</p>")
        if k in (5, 6):
            body.append(f"<div class='comments'>{notices[2]}</div><p class='notice'>{say(9)}</p>")
        whole = "".join(body)
        html = f"<body><nav>{say(5)}</nav><article>{whole}</article><p>{notices[3]}</p></body>" if k % 3 else f"<body><div>{whole}</div><p>{notices[3]}</p></body>"
        pages[k] = (f"http://{'big' if k >= 40 else 'small'}.example/{k}", html)
    for k in range(160, 166):  # near copies of one article
        pages[k] = ("http://big.example/x", pages[41][1].replace("</h1>", f" {k}</h1>"))
    pages |= {170: (None, None), 171: ("http://big.example/y", ""), 172: ("http://big.example/z", "<p>" + say(20_000))}
    df = spark.createDataFrame([(k, u, h, 1, "x", 2) for k, (u, h) in pages.items()], "page_id long, url string, html string, slot int, text string, part int")
    want = brute_extraction(pages)
    for size in ((3000, 1024), (1 << 23, 1024), (1 << 23, 20)):
        assert {x.page_id: x.text for x in extraction.extract_main_text(df, *size).collect()} == want, size
    assert all(notices[k % 2] not in want[k] for k in range(160) if k % 40 < 4 and k != 41)
    assert all(len(want[k]) > 20 for k in range(160, 166)) and notices[2] not in want[5]
    plain = {x.page_id: x.text for x in extraction.extract_main_text(df, shared=10**6, hinted=10**6).collect()}
    assert plain != want


def test_extraction_class_names(spark):
    """Class names inside an article drop nothing by themselves."""
    html = "<article><div class='article-header'><h1>Title</h1></div><section class='related-work'><p>Earlier work</p></section><p class='notice'>Mind this</p></article>"
    got = extraction.extract_main_text(spark.createDataFrame([(1, "http://a/1", html)], "page_id long, url string, html string")).first()
    assert got.text == "Title\nEarlier work\nMind this"


def test_suffix_array():
    r = np.random.default_rng(2)
    token, page = r.integers(0, 3, 400), np.repeat(np.arange(10), 40)
    got = extraction.shared_pages(token, page, 4)
    seen = collections.defaultdict(set)
    spots = [k for k in range(397) if page[k] == page[k + 3]]
    for k in spots:
        seen[tuple(token[k : k + 4])].add(page[k])
    assert all(got[k] == len(seen[tuple(token[k : k + 4])]) for k in spots)
    want = np.zeros(400, bool)
    for k in spots:
        if len(seen[tuple(token[k : k + 4])]) >= 3:
            want[k : k + 4] = True
    assert (extraction.spread(got >= 3, 4) == want).all()


def brute_components(n, percent, ts):
    sets = {}
    for i, t in enumerate(ts):
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "members"), [(3, 85, 1024), (5, 80, 4)])
def test_near_duplicates(docs, none, n, percent, members):
    got = rows(neardup.near_duplicates(docs, n, percent, members))
    for i, (size, component) in brute_components(n, percent, texts()).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (size, component, component == i), i
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_names(docs, spark):
    """String ids give the same components; repeated ids keep the links of each of their texts; null ids join their class."""
    plain = rows(neardup.near_duplicates(docs, 3, 85))
    for r in neardup.near_duplicates(docs.withColumn("doc_id", F.format_string("n%05d", "doc_id")), 3, 85).collect():
        assert (r.n_shingles, int(r.component_id[1:]), r.kept) == plain[int(r.doc_id[1:])][1:4]
    base, other = texts()[2], texts()[3]
    data = [(1, base), (5, base + " x"), (5, other), (9, other), (None, base), (None, "alone in its own words here")]
    got = neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, False), (0, 1, False), (1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]
    assert sorted(r.doc_id or 0 for r in got if r.stays) == [0, 1, 5]


def test_near_duplicates_hot_bucket(spark, monkeypatch):
    """In a bucket of one large component and a few others the members of the large one never meet each other in blocks."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    ts = [" ".join([*base, f"tail{k}"]) for k in range(60)] + [" ".join(base[:40] + [f"z{k}x{j}" for j in range(14)]) for k in range(3)]
    r.shuffle(ts)
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    want = brute_components(3, 85, ts)
    for members in (4, 1024):
        got = rows(neardup.near_duplicates(df, 3, 85, members))
        assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == want


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as P

    docs.select(*P.COLUMNS).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).select("doc_id").distinct()
    kept = {r.doc_id for r in got.collect()}
    after = {i: t for i, t in enumerate(texts()) if i in {r.doc_id for r in quality.repetition_rules(docs).where("kept").collect()} and t and any(c.isalpha() for c in t)}
    ids = sorted(after)
    want = {ids[c] for _, c in brute_components(5, 80, [after[i] for i in ids]).values()}
    assert kept == want


def test_language_learns_from_all(spark):
    """Profiles and the least score come from every labelled text: other ids, or other tasks, give the same."""
    r = random.Random(9)
    syllables = {"xa": ["th", "er", "on", "an", "is"], "yb": ["ção", "lh", "os", "ei"]}
    make = lambda k: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 9)))
    data = [(i, make(k), k) for i, k in enumerate(["xa"] * 4000 + ["yb"] * 500)] + [(9000, None, "xa"), (9001, "es", None), (9002, "1", "xa")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(docs, 40)
    grams = collections.Counter()
    for _, t, k in data:
        for w in (t or "").split() if k == "xa" else []:
            if w.isalpha():
                for n in (1, 2, 3):
                    padded = w if n == 1 else f" {w} "
                    grams.update((n, padded[j : j + n]) for j in range(len(padded) - n + 1))
    code = lambda n, g: (sum((0 if c == " " else ord(c)) << 16 * (n - 1 - j) for j, c in enumerate(g)) << 2) | n
    assert profiles["xa"] == [c for _, c in sorted((-v, code(n, g)) for (n, g), v in grams.items())[:40]]
    scores = sorted(x.score for x in language.identify_language(docs.where("lang is not null"), profiles).collect() if x.lang_pred != "und")
    least = scores[-(-len(scores) // 20) - 1]
    assert len(scores) == 4500 and 0 <= least - language._low_end(docs, profiles) <= 1 / language.STEPS
    limit = language.learn_limit(docs, profiles)
    assert limit > 0
    for other in (docs.withColumn("doc_id", F.col("doc_id") + 10**6), docs.repartition(7)):
        assert language.learn_profiles(other, 40) == profiles == language.learn_profiles(other, 40, held=50) and language.learn_limit(other, profiles) == limit


def test_language_sums_counts():
    """Counts of one language's n-gram are summed, other languages' stay apart; nothing gives nothing."""
    found = language._summed(np.array([1, 0, 1, 1]), np.array([7, 7, 7, 5]), np.array([2, 3, 4, 1]))
    assert [x.tolist() for x in found] == [[0, 1, 1], [7, 5, 7], [3, 1, 6]]
    assert [len(x) for x in language._summed(*[np.zeros(0, np.int64)] * 3)] == [0, 0, 0]


def test_pipeline_language_limit(spark):
    """Gibberish and languages that were not learned go, whatever their label; short clean texts stay."""
    import corpus_pipeline as P

    r = random.Random(4)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    low, b64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    bad = [" ".join(word(low, r.randrange(2, 10)) for _ in range(200)), " ".join(word(b64, 64) for _ in range(40)), "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", "Привет всем людям", "123"]
    good = ["This is the house of the man.", "The rest of the letter is here and it was not sent on the same day.", "Der Mann und die Frau sind in der Stadt.", "La maison est dans les montagnes."]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*P.COLUMNS).where("length(text) > 0")
    n = docs.count()
    assert n > 100
    more = spark.createDataFrame([(10**6 + k, t, "en" if k % 2 else None, "s", len(t)) for k, t in enumerate(bad + good)], docs.schema)
    stay = {x.doc_id for x in P.language_id(spark, docs.unionByName(more), "").collect()}
    assert {k for k in range(len(bad + good)) if 10**6 + k in stay} == set(range(len(bad), len(bad + good)))
    assert len(stay) >= 0.99 * n


def test_pipeline_odd_rows(spark, tmp_path):
    """Empty table; null ids and repeated rows: one of each group stays."""
    import corpus_pipeline as P

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    base, other = texts()[2], texts()[3]
    data = [(None, base, "a", None, 1), (None, base, "a", None, 1), (7, other, "a", "s", 1), (7, other, None, "s", 1), (8, other, "b", "s", 1), (9, None, None, None, None)]
    docs = spark.createDataFrame(data, kind)
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(0, base), (7, other), (9, "")])


def test_memory_of_pieces():
    """A memory that is full is emptied, and gives the same ids."""
    learnt = []
    memory = tokens.Memory(lambda run: learnt.append(run) or [len(run), 7], 400)
    r = random.Random(2)
    for _ in range(30):
        runs = [bytes(r.choices(b"abc", k=r.randrange(1, 5))) for _ in range(20)]
        data, ends = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(x) for x in runs])
        ids, size = memory.lookup(data, ends - [len(x) for x in runs], ends)
        assert ids.tolist() == [y for x in runs for y in (len(x), 7)] and size.tolist() == [2] * 20
    assert len(learnt) > len(set(learnt))


def test_small_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20), "", None, "y" * (5 << 20)] * 3)], names=["t"])
    parts = list(C.small([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) < 4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    """Components, at once and after more edges, against union by hand; loops and repeated edges are there."""
    from tidemark.llm.components import components, joined

    draw = random.Random(seed)
    first = [(draw.randrange(40), draw.randrange(40)) for _ in range(22)] + [(3, 3), (50, 51), (50, 51), *((60 + k, 61 + k) for k in range(9))]
    more = [(draw.randrange(45), draw.randrange(45)) for _ in range(6)] + [(60, 51), (80, 81)]

    def want(edges):
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for u, v in edges:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        return sorted(root.items())

    table = lambda e: spark.createDataFrame(e, "u long, v long")
    label = components(table(first))
    assert sorted(map(tuple, label.collect())) == want(first)
    assert sorted(map(tuple, joined(label, table(more)).collect())) == want(first + more)
    assert components(table([])).count() == 0


def test_pipeline_without_labels(spark):
    """Where no row has a language, the language stage keeps all rows."""
    import corpus_pipeline as P

    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, None, None, "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert P.language_id(spark, docs, "").count() == 2
