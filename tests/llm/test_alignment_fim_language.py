import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldscope.llm import alignment, fim, language, queries
from fieldscope.llm.common import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, units string, h1 string, n string, held_out string, pair string"
ODD = [
    None, "", " ", "  ", "\n", "\n\n a", "a", "a\n", " a", "a ", "a  b", "a\n\nb \n c", "a \nb", "a\tb\r\nc", "a▁b", "▁", "<s> </s> <unk> <0x0A>", "<|endoftext|>x", "\x00\x01", "it's I'll 'S",
    "日本語テスト 中文", "😀👩‍👩 é", "x\xa0y　z\x85w v", "a\x1cb \x1f c", "½²①٣ 123 4567", "ﬁ É", "word " * 3000, "x" * 3000, "same text here", "same text here", "<P>a\nb\n", "a<S>\nb", "a\nb<M>", "<", "P>\n<", "a\n<\nS>\nM>\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    signs = ["the ", "Mat", "s", " ", "  ", "\n", "\n\n", "é", "Σ", "日", ",", ". ", "ing", "'s", "1", "\t", "\xa0", "\r", "<", "P>", "un", "believ", "able"]
    more = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    rows = [(i, t, "en", "s", "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(ODD + more)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id\nhere", None, None, "c", "c", "c", "c", "c")], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_alignment(texts):
    """The contract, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    level = {c: i for i, c in enumerate_bytes()}

    def tokens(text):
        if not text:
            return None
        x = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(level[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (one, two) if b"".join(t for _, t in one) == want == b"".join(t for _, t in two) else None

    def spans(side):
        out, at = [], 0
        for i, t in side:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    found, counts = [], Counter()
    for t in texts:
        pair = tokens(t)
        if pair is None:
            found.append(None)
            continue
        x, y = map(spans, pair)
        links = [(i, j) for i, p, q in x for j, r, s in y if p < s and r < q]
        counts.update(links)
        both = sorted({q for _, _, q in x} & {s for _, _, s in y})
        groups, low = [], 0
        for e in both:
            groups.append(",".join(str(i) for i, p, q in x if p >= low and q <= e) + "|" + ",".join(str(j) for j, r, s in y if r >= low and s <= e))
            low = e
        found.append((len(x), len(y), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[p] == best[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), ";".join(f[2])) for f in found]
    return rows, counts


def enumerate_bytes():
    """Byte and its sign in the byte-level alphabet."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return [(b, chr(b)) for b in own] + [(b, chr(256 + i)) for i, b in enumerate(b for b in range(256) if b not in own)]


def test_the_byte_alphabet():
    assert len({c for _, c in enumerate_bytes()}) == 256


def test_alignment_equals_brute_force(docs, monkeypatch):
    short = [r for r in docs.collect() if r["text"] is None or len(r["text"]) < 1000]
    df = docs.where("text is null or length(text) < 1000")
    want, counts = brute_alignment([r["text"] for r in short])
    kept = alignment.count_pairs(df, A, B)
    got = Counter(tuple(r) for r in alignment.align(df, kept, A, B).collect())
    assert got == Counter((r["doc_id"], *w) for r, w in zip(short, want, strict=True))
    assert {(r["a"], r["b"]): r["n"] for r in kept.pairs().collect()} == dict(counts)
    kept.remove()
    digests = Counter((r["doc_id"], r["groups_sha256"]) for r in alignment.align_corpus(df, A, B, digest=True).collect())
    assert digests == Counter((r["doc_id"], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "") for r, w in zip(short, want, strict=True))


def test_units_join_to_the_text_and_tokens_to_those_of_the_whole(docs):
    own = alignment.aligner(A, B)
    assert own.cuts == " \n"
    for r in docs.collect():
        if r["text"] and "▁" not in r["text"]:
            units = [u for part in own.units(r["text"]) for u in part]
            assert "".join(units) == " " + r["text"]
            assert [i for u in own.encode_b(units) for i in u] == own.b.encode(r["text"])
            assert [i for u in units for i in own.encode_a(u)] == own.encode_a(" " + r["text"])


def test_bounds_change_nothing(docs):
    """However early units and pairs are passed on, and in however many files."""
    own, texts = alignment.aligner(A, B), [r["text"] for r in docs.collect()]
    whole_counts = Counter()
    for t in texts:
        for part in own.units(t):
            whole_counts.update(alignment.Links(own, part).pair.tolist())
    old = alignment.AT_ONCE, alignment.LONG_TEXT, alignment.IN_LIST
    alignment.AT_ONCE, alignment.LONG_TEXT, alignment.IN_LIST = 7, 20, 3
    try:
        seen = Counter()
        for t in texts:
            for part in own.units(t):
                assert len(part) <= 20
                seen.update(part)
        pairs, n = alignment.summed(*map(np.concatenate, zip(*((x.pair, np.array([seen[u] for u in some])[x.unit]) for some in [list(seen)] for x in [alignment.Links(own, some)]), strict=True)))
        assert dict(zip(pairs.tolist(), n.tolist(), strict=True)) == dict(whole_counts)
    finally:
        alignment.AT_ONCE, alignment.LONG_TEXT, alignment.IN_LIST = old


def test_alignment_of_an_empty_table(empty):
    assert alignment.align_corpus(empty, A, B).collect() == []


def brute_fim(doc_id, text, percent=100, spm=50):
    units, text = re.findall(r"[^\n]*\n|[^\n]+", text or ""), text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < spm:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}", text


def test_fim_equals_a_plain_calculation(docs, empty):
    rows = Counter((r["doc_id"], r["n"], r["form"], r["prefix"], r["middle"], r["output"], r["back"]) for r in fim.transform(docs).withColumn("back", fim.restored()).collect())
    assert rows == Counter((r["doc_id"], *brute_fim(r["doc_id"], r["text"])) for r in docs.collect())
    forms = Counter(k[2] for k in rows.elements())
    assert forms["psm"] > 100 and forms["spm"] > 100 and forms["plain"] >= 5
    some = {r["doc_id"]: r["form"] for r in fim.transform(docs, percent=30, spm_percent=0).collect()}
    assert some == {r["doc_id"]: brute_fim(r["doc_id"], r["text"], 30, 0)[1] for r in docs.collect()}
    assert fim.digests(empty).collect() == []


def test_fim_sentinels_and_units_of_ones_own(docs):
    own = ("[pre]", "[suf]", "[mid'\\]")
    rows = fim.transform(docs, unit=r"\S+\s*|\s+", sentinels=own).withColumn("back", fim.restored(sentinels=own)).collect()
    assert all(r["back"] == r["text"] for r in rows) and {r["form"] for r in rows} == {"psm", "spm", "plain"}
    assert any(r["output"].startswith("[pre]") and "[mid'\\]" in r["output"] for r in rows)
    for bad in (("<a>", "<a>", "<b>"), ("", "<a>", "<b>"), ("ab", "bc", "<b>"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)


def test_fim_plan_has_no_python_and_no_shuffle(docs):
    plan = fim.digests(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Repartition" not in plan.split("Project", 1)[0]


def brute_language(rows, test):
    """Naive Bayes with a dict, a character run at a time."""
    counts, docs = {}, Counter(lang for lang, _ in rows)

    def runs(text):
        t = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
        t = t.ljust(4)
        for n in range(1, 5):
            for i in range(len(t) - n + 1):
                h = 0
                for c in t[i : i + n]:
                    h = (h + ord(c) + 1) * 0x01000193 & 0xFFFFFFFF
                yield ((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 8 & 0xFFFF

    for lang, t in rows:
        if any(map(str.isalpha, t)):
            counts.setdefault(lang, Counter()).update(runs(t))
    names = sorted(docs)
    out = []
    for t in test:
        if not t or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
            continue
        own = list(runs(t))
        logs = []
        for x in names:
            c = counts.get(x, Counter())
            total = sum(c.values()) + 0.5 * 65536
            logs.append(np.log(docs[x] / len(rows)) + sum(np.log((c[g] + 0.5) / total) for g in own))
        i = int(np.argmax(logs))
        out.append((names[i], 1 / np.exp(np.array(logs) - logs[i]).sum()))
    return out


WORDS = {"en": "the cat sat on mats and ran over hills", "de": "der Hund läuft über die Straße und schläft", "fr": "le chat était très près de la fenêtre", "ru": "кошка сидит на окне и смотрит"}


def language_rows(n=240):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(1, 30))), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]
    return [*rows, (n, None, "en"), (n + 1, "", "en"), (n + 2, "123 ½ --", "en"), (n + 3, "x", None), (n + 4, "der " * 70000, "de"), (None, "the cat", "en")]


def test_language_equals_naive_bayes_by_hand(spark, monkeypatch):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    want = brute_language([(lang, t) for i, t, lang in rows if not held(i) and t is not None and lang], [t for _, t, _ in rows])
    got = {r["doc_id"]: r for r in language.predict(df, language.train(df)).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (lang, p) in zip(rows, want, strict=True):
        r = got[i]
        assert r["held_out"] == held(i) and r["lang_pred"] == lang and abs(r["score"] - p) < 1e-3
    right = [got[i]["lang_pred"] == lang for i, t, lang in rows if t and lang and any(map(str.isalpha, t)) and held(i)]
    assert np.mean(right) > 0.95


def test_language_in_pieces_and_in_few_buckets():
    model = language.Model(["a", "b"], np.random.default_rng(1).normal(size=(1 << 10, 2)).astype(np.float32), np.array([-0.5, -0.9]))
    texts = [language.letters(t) if t else None for t in ["eins zwei drei", None, "x", "hello world " * 500, "ab"]]
    best, p = language.score(model, texts)
    old = language.PIECE, language.CELLS
    language.PIECE, language.CELLS = 1024, 1024
    try:
        again, q = language.score(model, texts)
    finally:
        language.PIECE, language.CELLS = old
    assert best.tolist() == again.tolist() and np.allclose(p, q)
    assert language.bucket_count(4) == 1 << 16 and language.bucket_count(7000) * 7000 <= language.MOST_CELLS


def test_language_learns_a_bounded_sample_of_each(spark):
    df = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    m = language.train(df, per_language=20)
    assert m.languages == sorted(WORDS)
    got = language.predict(df, m).join(df, "doc_id").where("lang_pred <> 'und' and lang is not null").select((F.col("lang_pred") == F.col("lang")).cast("int").alias("ok"))
    assert got.agg(F.avg("ok")).first()[0] > 0.9


def test_language_without_labels_and_of_an_empty_table(spark, docs, empty):
    nothing = language.train(empty)
    assert nothing.languages == [] and language.predict(empty, nothing).collect() == []
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert language.predict(docs, language.train(docs)).count() == docs.count()


def test_language_of_held_out_documents(spark):
    """Accuracy on the fold that is not learned from."""
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op13_language(spark, sf).join(d, "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.95
