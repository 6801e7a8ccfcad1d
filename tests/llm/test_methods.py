"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from markbook.llm import components, decontam, eliasfano, imatch, langid, linededup, mixing, pii, ppm, queries, simhash, tokenbin

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_chat_agrees_with_sql(spark, agree):
    agree(queries.op4_chat(spark, SF), queries.oracle_sql()["op4_chat"])


def test_language_held_out_accuracy(spark):
    got = queries.op1_langid(spark, SF)
    labels = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got.collect())
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_text_vector_is_the_sum_of_bound_letters():
    letters = langid.letter_vectors(64)
    text = "Ab c-déf"
    k = langid.classes()
    want = np.zeros(64)
    seq = [0] + [int(k[ord(c)]) for c in "ab"] + [0] + [int(k[ord("c")])] + [0] + [int(k[ord(c)]) for c in "déf"] + [0]
    for i in range(1, len(seq) - 1):
        if seq[i]:
            want += letters[2][seq[i - 1]] * letters[1][seq[i]] * letters[0][seq[i + 1]]
    codes, _ = langid.grams([text])
    assert np.array_equal(langid.gram_vectors(codes, letters).sum(axis=0, dtype=int), want)


def find_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def union(parent, a, b):
    a, b = find_root(parent, a), find_root(parent, b)
    parent[max(a, b)] = min(a, b)


def test_simhash_against_brute_force(spark, texts):
    prints = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    parent = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                union(parent, a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", find_root(parent, d)) for d in prints}


@pytest.mark.parametrize("long_posting", [0, 4, 64])
def test_dense_postings_lose_no_link(spark, long_posting):
    rng, points = random.Random(3), {0, (1 << 64) - 1}
    while len(points) < 250:
        p = rng.choice(sorted(points))
        for _ in range(rng.randint(1, 3)):
            p ^= 1 << rng.randrange(64)
        points.add(p)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in points]
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, long_posting)).collect()}
    parent = {p: p for p in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                union(parent, a, b)
    assert {p: got.get(p, p) for p in signed} == {p: find_root(parent, p) for p in signed}


def five_word_sets(texts):
    w = {d: t.lower().split() for d, t in texts.items()}
    return {d: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for d, x in w.items()}


def test_near_copies_against_brute_force(spark, texts):
    rng = random.Random(12)
    some = dict(texts)
    for d in range(10_000, 10_150):  # edits of whole texts, at likenesses about 0.8
        w = texts[rng.choice(sorted(texts)[:60])].split()
        for _ in range(rng.choice([1, 1, 2, len(w) // 60, len(w) // 50])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["changed", "", "two words"])
        some[d] = " ".join(w)
    sets, parent, names = five_word_sets(some), {d: d for d in some}, sorted(some)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (k := len(x & y)) >= 0.8 * (len(x) + len(y) - k):
                union(parent, a, b)
    want = {d for d in some if find_root(parent, d) == d}
    got = [r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(some.items()), "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(some) - len(got) >= 0.95 * (len(some) - len(want))


def test_near_copies_keep_other_documents_of_an_id(spark):
    a, b, c = ("the cat sat on the mat while rain fell", "le chat dort sur la table et il pleut", "der hund liegt unter dem tisch und es regnet")
    kind = "doc_id long, text string, row int, id string"
    rows = [(None, a, 1, "x"), (1, b, 2, "x"), (1, c, 3, "x"), (2, a + " ", 4, "x"), (1, c, 3, "x"), (None, None, 5, "x"), (None, b.upper(), 6, None), (3, "", 7, "x")]
    got = simhash.one_of_each(spark.createDataFrame(rows, kind))
    assert sorted(r.row for r in got.collect()) == [2, 3, 4, 7]
    assert got.columns == ["doc_id", "text", "row", "id"]


def test_shared_bytes(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    pairs += [(a, a ^ sum(rng.randrange(256) << (8 * i) for i in rng.sample(range(7), 4))) for a, _ in pairs] + [(-1, 0), (5, 5), (-(1 << 63), 0)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.shared_bytes(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == sum(((r.a ^ r.b) >> (8 * i)) & 255 == 0 for i in range(8)) for r in got)


def test_components_of_a_long_path(spark):
    got = components.components(spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(40)] for _ in range(6)]
    docs, dirty = [], set()
    for d in range(40):
        body = [word() for _ in range(120)]
        if d % 4 == 0:
            part = list(items[d % 6][5:35])
            for i in range(3, 30, 8):
                part[i] = word()
            body[50:50] = part
            dirty.add((d, d % 6))
        if d % 4 == 1:
            body[10:10] = items[0][:8]  # too short an overlap
        docs.append((d, " ".join(body)))
    bench = spark.createDataFrame([(i, ", ".join(x).upper()) for i, x in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == dirty
    assert all(r.doc_token == 50 and r.item_token == 5 and r.n_tokens >= r.n_equal + 3 >= 25 for r in got)


def test_decontamination_against_exact_windows(spark, texts):
    tok = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = {r.item_id: tok(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    where = collections.defaultdict(set)
    for i, x in items.items():
        n = min(13, len(x))
        for j in range(len(x) - n + 1):
            where[tuple(x[j : j + n])].add(i)
    want = {(d, i) for d, t in texts.items() for w in [tok(t)] for n in {len(k) for k in where} for j in range(len(w) - n + 1) for i in where.get(tuple(w[j : j + n]), ())}
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontam(spark, SF).collect()} >= want


@pytest.mark.parametrize("size,replaced", [(16, 3), (20, 4)])
def test_decontamination_reports_all_that_meet_the_rule(spark, size, replaced):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(size)] for _ in range(150)]
    docs = []
    for i, x in enumerate(items):
        gone = set(rng.sample(range(size), replaced))
        docs.append((i, " ".join([word() for _ in range(20)] + [word() if j in gone else w for j, w in enumerate(x)] + [word() for _ in range(20)])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert len(got) >= 0.95 * len(items)  # the seeds miss a few
    assert all(r.doc_id == r.item_id and r.n_equal == size - replaced and r.n_tokens <= size for r in got)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "255", "999", ".", ".", "@", "a", "b-c", " ", "+1", "(555)", "-", "4111111111111111", "é", "!"]), max_size=30).map("".join))
def test_patterns_match_their_expressions(text):
    n = lambda s: len(re.sub("[^0-9]", "", s))
    want = [("email", *m.span()) for m in EMAIL.finditer(text)]
    want += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    want += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= n(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    want += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= n(m[0]) <= 15]
    assert pii.base_spans(text) == want


def test_personal_data_of_every_document_against_the_expressions(spark, texts):
    """Counts, digest and spans of the query: patterns by their expressions, added spans disjoint from them and decoded by the field."""
    import hashlib

    n = lambda s: len(re.sub("[^0-9]", "", s))
    field = pii.trained()
    for r in queries.op6_pii(spark, SF).collect():
        text = texts[r.doc_id]
        want = [("email", *m.span()) for m in EMAIL.finditer(text)]
        want += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= n(m[0]) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
        want += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= n(m[0]) <= 15]
        assert r.base_sha256 == hashlib.sha256(pii.shown(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in pii.KINDS]
        more = [s for s in field.spans(text) if not any(a < s[2] and s[1] < b for _, a, b in want)]
        assert r.spans == pii.shown(sorted(want + more, key=lambda s: (pii.TYPES.index(s[0]), s[1], s[2])))
        assert (r.n_spans, r.n_added) == (len(want) + len(more), len(more))


HARD = [
    ("my password=hunterhunter today", ["secret"]), ("ssn 078-05-1120 ok", []), ("call 06 12 34 56 78 now", ["phone"]), ("iban DE44 5001 0517 5407 3249 31", []), ("the key: always be kind", []),
    ("pay 12.50 on 2024-03-04 v1.2.3", []), ("fe80:0001:0202:b3ff:fe1e:8329:aa00:1111 x", []), ("secret: recipes are good", []), ("tel (555) 123-4567", ["phone"]), ("chapter 12, page 340", []),
]


@pytest.mark.parametrize(("text", "kinds"), HARD)
def test_field_on_hand_made_cases(text, kinds):
    assert [k for k, *_ in pii.find(text, pii.trained())[1]] == kinds


def test_field_on_held_out_sentences():
    field, rng = pii.trained(), random.Random(99)
    hit = found = gold = 0
    for _ in range(60):
        text, spans = pii.sentence(rng)
        got = set(field.spans(text))
        hit, found, gold = hit + len(got & set(spans)), found + len(got), gold + len(spans)
    assert hit / found > 0.85 and hit / gold > 0.8


def test_field_decodes_the_best_segmentation():
    field, rng = pii.trained(), random.Random(4)

    def best(text, toks):
        found = field.segments(text, toks)
        options = {(i, j): field.scores(f) for j, fs in enumerate(found) for i, f in fs}

        def walk(at, last):
            if at == len(toks):
                return 0.0
            out = field.moves[last, pii.OUT] + walk(at + 1, pii.OUT)
            for j in range(at + 1, min(len(toks), at + pii.LONGEST) + 1):
                if (at, j) in options:
                    for y in range(pii.OUT):
                        out = max(out, field.moves[last, y] + options[at, j][y] + walk(j, y))
            return out

        return walk(0, pii.OUT)

    for _ in range(4):
        text, _ = pii.sentence(rng)
        toks = pii.tokens(text, 0, len(text))[:6]
        path = field.decode(text, toks)
        score, last, at = 0.0, pii.OUT, 0
        starts = {i: (y, j) for y, i, j in path}
        options = {(i, j): field.scores(f) for j, fs in enumerate(field.segments(text, toks)) for i, f in fs}
        while at < len(toks):
            y, end = starts.get(at, (pii.OUT, at + 1))
            score += field.moves[last, y] + (options[at, end][y] if y != pii.OUT else 0)
            last, at = y, end
        assert abs(score - best(text, toks)) < 1e-9


def test_imatch(spark, texts):
    got = {r.doc_id: r for r in queries.op7_imatch(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    same = collections.defaultdict(set)
    import hashlib

    for i, d in enumerate(order):
        own, other = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(own) // 2
        assert got[d].n_chars == len(own)
        assert got[d].edited_sha256 == hashlib.sha256((own[: len(own) - half] + other[:half]).encode()).hexdigest()
        same[own].add(got[d].fingerprint)
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert all(len(v) == 1 for v in same.values())
    mean = lambda k: sum(getattr(r, k) for r in got.values()) / len(got)
    assert mean("near_edited") > 5 * mean("near_next")


def test_imatch_against_brute_force(spark, texts):
    """Fingerprints and likenesses from the lexicon by plain sets."""
    words = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if w}
    got = {r.doc_id: r for r in queries.op7_imatch(spark, SF).collect()}
    lex = {r.term: (r.code & ((1 << 64) - 1), r.subsets) for r in imatch.lexicon(spark.read.parquet(f"{SF}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"))).collect()}
    order, mask = sorted(texts, reverse=True), (1 << 64) - 1
    every = {w for d in texts for w in words(texts[d])}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}

    def prints(text, names):
        hit = [lex[hashes[w]] for w in names if hashes.get(w) in lex]
        parts = [0] * imatch.SUBSETS
        whole = 0
        for code, subsets in hit:
            whole ^= code
            for j in range(imatch.SUBSETS):
                if subsets >> j & 1:
                    parts[j] ^= code
        return (whole if hit else None), parts

    for d in order[::7]:
        whole, parts = prints(texts[d], words(texts[d]))
        want = "".join(f"{p:016x}"[-8:] for p in parts)
        assert got[d].fingerprint[16:] == want
        if whole is not None:
            assert got[d].fingerprint[:16] == f"{whole & mask:016x}"


def test_imatch_lexicon_band(spark):
    docs = spark.createDataFrame([(f"all all w{i % 10} only{i}",) for i in range(100)], "text string")
    lex = {r.term for r in imatch.lexicon(docs, "text", 0.05, 0.2).collect()}
    assert lex == {r[0] for r in spark.range(10).selectExpr("xxhash64(concat('w', id))").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    r = eliasfano.Reader(eliasfano.encode(np.array(values, np.uint64)))
    assert r.all().tolist() == values
    assert [r.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000)).astype(np.uint64)
    assert 8 * len(eliasfano.encode(values)) / len(values) < math.log2(int(values[-1]) / len(values)) + 2.5


def test_tokens_round_trip(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    manifest = tokenbin.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), path, 1)
    got = {r.doc_id: r for r in tokenbin.read_tokens(manifest).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*tok.encode(texts[d], add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = tokenbin.Shard(manifest.first().path)
    ids = [*tok.encode(texts[shard.doc_id(1)], add_special_tokens=False).ids, 1]
    assert shard.tokens(*shard.span(1)).tolist() == ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Hello,", "wörld!!", "it's", "<|endoftext|>", "ΣΑΣ", "İ", "ǅ", "é́", "12.5", "DON'T'", "...|", "中文", " ", "\x1c", "ʼn", "ÉTÉ.", "a", "'s", "re"]), max_size=12), st.sampled_from([" ", "\n", "", "  "]))
def test_words_encode_as_whole_texts(words, sep):
    enc = tokenbin.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = sep.join(words)
    assert np.frombuffer(enc.encode([text.encode()])[0], enc.kind).tolist() == enc.tok.encode(text, add_special_tokens=False).ids


def ppm_brute(train, text, order=ppm.ORDER):
    trie = collections.defaultdict(collections.Counter)
    for b in train:
        b = b"\n" * order + b
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie[b[i - k : i]][b[i]] += 1
    b, total = b"\n" * order + text, 0.0
    for i in range(order, len(b)):
        gone, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = {c: n for c, n in trie[b[i - k : i]].items() if c not in gone} if b[i - k : i] in trie else {}
            if not seen:
                continue
            n = sum(seen.values())
            if b[i] in seen:
                p *= (seen[b[i]] - 0.5) / n
                break
            p *= len(seen) / 2 / n
            gone |= set(seen)
        else:
            p /= 256 - len(gone)
        total += math.log10(p)
    return total


def test_ppm_against_a_walked_trie(spark, texts):
    ids = sorted(texts)
    words = lambda d: texts[d].encode().lower().split()
    learned = ppm.train(spark.createDataFrame([(texts[d],) for d in ids[:25]], "text string"))
    train = [ppm.coded(words(d)) for d in ids[:25]]
    tests = [words(d)[:60] for d in ids[25:31]] + [[], ["中文字".encode(), b"xyz"]]
    for got, w in zip(learned.model.score(tests), tests):
        assert abs(got - ppm_brute(train, ppm.coded(w))) < 1e-3


@pytest.mark.parametrize("share", [ppm.LEAST_SHARE, 0.01])
def test_base_score(spark, texts, share):
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    count = collections.Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    for r in ppm.score(spark.read.parquet(f"{SF}/documents.parquet"), least_share=share).collect():
        t = tokens[r.doc_id]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(w in count for w in t), n, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0


def test_ppm_keeps_every_gram(spark, texts):
    ids = sorted(texts)[:50]
    some = {d: b" ".join(texts[d].encode().lower().split()[:60]).decode() for d in ids}
    docs = spark.createDataFrame([*some.items(), (None, "never seen: \u4e2d\u6587 qzx")], "doc_id long, text string")
    coded = {d: ppm.coded(t.encode().lower().split()) for d, t in {**some, None: "never seen: \u4e2d\u6587 qzx"}.items()}
    train = [coded[d] for d in ids if zlib.crc32(str(d).encode()) % 10]
    got = {r.doc_id: r.score for r in ppm.score(docs, least_share=0.001).collect()}
    checked = [d for d in ids if not zlib.crc32(str(d).encode()) % 10] + ids[:4] + [None]
    for d in checked:
        assert abs(got[d] - ppm_brute(train, coded[d])) < 1e-6 * abs(got[d])
    assert all(abs(got[r.doc_id] - r.score) < 1e-3 for r in ppm.score(docs).collect())


def line_brute(texts, least=0.8, size=linededup.SIZE):
    where = {}
    for d in sorted(texts):
        for i, line in enumerate(texts[d].split("\n")):
            if line.strip():
                where.setdefault(line, []).append((d, i))
    sets = {x: {x[i : i + size] for i in range(len(x) - size + 1)} for x in where}
    parent = {x: x for x in where}
    names = list(where)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= least * max(len(x), len(y)) and (k := len(x & y)) >= least * (len(x) + len(y) - k):
                union(parent, a, b)
    home = {}
    for x, at in where.items():
        r = find_root(parent, x)
        home[r] = min(home.get(r, at[0]), at[0])
    return {(d, i) for x, at in where.items() for d, i in at if (d, i) != home[find_root(parent, x)]}


@pytest.mark.parametrize("deepest", [2])
def test_lines_against_brute_force(spark, texts, deepest):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(30)) for _ in range(4)]
    some = {d: texts[d] for d in sorted(texts)[:40]}
    for d in range(10_000, 10_060):
        w = rng.choice(base).split()
        w[rng.randrange(30)] = "changed" + str(d)
        some[d] = " ".join(w) + "\n\nshort\nshort"
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    got = {(r.doc_id, i) for r in linededup.dropped_lines(docs, deepest=deepest).collect() for i in r.dropped}
    want = line_brute(some)
    assert got <= want and len(got) >= 0.97 * len(want)


LETTERS64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.mark.parametrize("letters,size", [([chr(c) for c in range(0x4E00, 0x9000)], 400), (LETTERS64, 400), (LETTERS64, 90)])
def test_long_lines_without_spaces(spark, letters, size):
    rng = random.Random(8)
    lines = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(40)]
    docs = [(i, x) for i, x in enumerate(lines)] + [(100 + i, x[: size // 2] + "\u3042" + x[size // 2 + 1 :]) for i, x in enumerate(lines)]
    found = {r.doc_id for r in linededup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {d for d, _ in line_brute(dict(docs))}
    assert found <= want and len(found) >= 0.95 * len(want)


@pytest.mark.parametrize("tree", [True, False])
def test_a_drifting_group_of_lines_stays_together(spark, tree):
    """Each line is one word away from an earlier one; the whole is one component, by links that few others double."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    lines = [[word() for _ in range(24)]]
    while len(lines) < 300:
        w = list(rng.choice(lines) if tree else lines[-1])
        w[rng.randrange(24)] = word()
        lines.append(w)
    docs = [(i, " ".join(w)) for i, w in enumerate(lines)]
    got = {(r.doc_id, i) for r in linededup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() for i in r.dropped}
    want = line_brute(dict(docs))
    assert got <= want and len(got) >= len(want) - 2


def test_cleaned_texts(spark):
    docs = spark.createDataFrame([(1, "a line of text\n\nb"), (2, "a line of text\n\nc"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.without_dropped(docs).collect()} == {1: "a line of text\n\nb", 2: "\nc", 3: None}


def test_rates_meet_reachable_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 900, 400)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    shares = np.array([0.5, 0.35, 0.15])
    rate = mixing.replay(p, mixing.solve(members, shares))
    total = (rate * n) @ p
    assert rate.min() >= 0 and np.abs(total / total.sum() - shares).max() < 5e-3


def test_mixing_finds_domains_and_keeps_clean_documents(spark):
    good, bad = "alpha beta gamma delta", "scum trash moron clown"
    docs = spark.createDataFrame([(i, (bad if i % 5 == 0 else good) + f" word{i % 7}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = mixing.mixture(docs, labels, {"good": 0.99, "toxic": 0.01, "plain": 0.0}).collect()
    assert all((r.p_toxic > 0.5) == (r.doc_id % 5 == 0) for r in got)
    assert all(r.copies >= 1 for r in got if r.doc_id % 5) and sum(r.copies for r in got if r.doc_id % 5 == 0) < 20
