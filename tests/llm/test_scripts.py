"""Language ID in scripts other than Latin, and against vectors walked letter by letter."""

import random

import numpy as np
import pytest

from markbook.llm import langid

# Common words of each language, as text to learn and to tell apart.
WORDS = {
    "ru": "и в не на что с как это по но из у за от так для если уже ещё только когда можно человек время очень был быть который этот свой мой наш где здесь после",
    "uk": "і в не на що з як це по але із у за від так для якщо вже ще тільки коли можна людина час дуже був бути який цей свій мій наш де тут після",
    "bg": "и в не на че с как това по но от у за от така за ако вече още само кога може човек време много беше бъде който този свой мой наш къде тук след",
    "el": "και να το είναι η της με για που στο από δεν θα τα τον αυτό ένα μας ήταν πολύ αλλά όταν μπορεί άνθρωπος χρόνος μετά εδώ πού δικός",
    "hi": "है के में की से को और का यह एक पर नहीं कि जो भी तो था हैं लिए अपने समय लोग बहुत कुछ जब यहाँ बाद कहाँ हमारा मेरा",
    "mr": "आहे च्या मध्ये ची पासून ला आणि चा हे एक वर नाही की जो पण तर होता आहेत साठी आपल्या वेळ लोक खूप काही जेव्हा इथे नंतर कुठे आमचा माझा",
    "ja": "これ は です それ が あり ます して いる こと ない もの ひと とき よう その から まで とても もし わたし",
    "zh": "这 是 的 不 了 在 人 有 我 他 个 们 中 来 上 大 为 和 国 地 到 以 说 时 要 就 出 会 可 也 你",
}


def text_of(lang, rng, n=40):
    words = [rng.choice(WORDS[lang].split()) for _ in range(n)]
    return " ".join(w.upper() if rng.random() < 0.2 else w.title() if rng.random() < 0.2 else w for w in words)


def test_languages_that_share_a_script(spark):
    rng = random.Random(2)
    rows = [(i, text_of(lang, rng), lang) for i, lang in enumerate(x for x in WORDS for _ in range(12))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [(lang, text_of(lang, rng, 12)) for lang in WORDS for _ in range(25)]
    names, scores = model.predict([t for _, t in held])
    assert sum(a == b for a, (b, _) in zip(names, held)) >= 0.97 * len(held) and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("a,b", [("ПРИВЕТ Мир", "привет мир"), ("ΑΘΗΝΑ", "αθηνα"), ("ÉCOLE", "école"), ("ՀԱՅ", "հայ")])
def test_case_is_folded_in_every_script(a, b):
    assert np.array_equal(langid.grams([a])[0], langid.grams([b])[0])


def test_letters_have_vectors_of_their_own():
    letters = langid.letter_vectors()
    some = [ord(c) for c in "абвгдеαβγअआइ中国人あいう"]
    v = letters[0][np.array(some)].astype(int)
    cosine = v @ v.T / letters.dim
    assert (np.abs(cosine - np.eye(len(some))) < 0.25).all()


def walked(text, letters):
    """The sum of bound vectors, letter by letter."""
    fold, seq = langid.classes(), [(0, False)]
    for ch in text or "":
        c = int(fold[ord(ch)])
        if c or seq[-1][0]:
            seq.append((c, ch.isalpha()))
    seq.append((0, False))
    out = np.zeros(letters.dim, int)
    for (a, _), (b, is_letter), (c, _) in zip(seq, seq[1:], seq[2:]):
        if is_letter:
            out += letters[2][a].astype(int) * letters[1][b] * letters[0][c]
    return out


def test_whole_documents_against_walked_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(40).collect()
    letters = langid.letter_vectors(128)
    texts = [r.text for r in rows] + ["हिन्दी भाषा", "Привет — мир!", None, "12 34", "中文 и English"]
    sums = {}
    for r in rows:
        if r.lang and r.text:
            sums[r.lang] = sums.get(r.lang, 0) + walked(r.text, letters)
    model = langid.train(spark.createDataFrame([(r.text, r.lang) for r in rows], "text string, lang string"), dim=128)
    assert model.langs == tuple(sorted(sums))
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores):
        v = walked(text, letters)
        if not any(c.isalpha() for c in text or ""):
            assert (name, score) == ("und", 0)
            continue
        cosine = {k: float(v @ u) / (np.linalg.norm(v) or 1) for k, u in unit.items()}
        assert abs(cosine[name] - max(cosine.values())) < 1e-5 and abs(score - min(1, max(0, cosine[name]))) < 1e-5


def test_many_letters_at_once():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    codes, _ = langid.grams([text])
    present, number = langid.distinct(codes)
    assert np.array_equal(present[number], codes) and len(present) == len(set(codes.tolist()))
    small = langid.grams(["abc abd"])[0]
    present, number = langid.distinct(small)
    assert np.array_equal(present[number], small) and sorted(present.tolist()) == present.tolist()
