"""Byte-level BPE, periodic runs and spelling variants against brute force, and hashes, ids, rows and names that collide."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ridecast.llm import (brown_lm, byte_bpe, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, periodic_runs,
                          spelling, substring_dedup)
from ridecast.llm.common import find_words, hash_windows, hash_words, space_words
from ridecast.llm.queries import (_made_periodic, op11_byte_bpe, op12_periodic_runs, op13_spelling_variants, tokenizer_path,
                                  vocabulary)

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def with_clashes(df):
    """Columns of the names that operators use inside."""
    for name in ("key", "ids", "n", "word", "runs", "row", "_doc", "_away", "_spans", "spans", "hit", "id"):
        df = df.withColumn(name, F.lit(name))
    return df


# --- byte-level BPE -------------------------------------------------------------------------------------------------

def odd_texts():
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "é", "中", "文", "한", "😀", "1", "٣", "½", "'s", "'ll", "-",
             "the", "ing", "‍", "́", "ß", "И", "\x00", "﻿", "A", "zz", "<|endoftext|>", "�"]
    return [None, "", " ", "\n\n", "a" * 70_000, "ab" * 5_000 + " " + "x" * 3_000] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_byte_bpe_equals_tiktoken(spark):
    ranks = byte_bpe.read_ranks(vocabulary())
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts()
    docs = with_clashes(table(spark, list(enumerate(texts)) + [(None, "a null key"), (3, texts[3]), (3, texts[3])]))
    got = byte_bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        text = "a null key" if r.doc_id is None else texts[r.doc_id] or ""
        assert r.ids == whole.encode_ordinary(text) and r.n_tokens == len(r.ids)
    packed = byte_bpe.encode(docs, vocabulary(), public_tokenizers.PATTERN, packed=True)
    for ids in (got, packed):
        assert {(r.doc_id, r.text) for r in byte_bpe.decode(ids, vocabulary()).collect()} == \
            {(i, t or "") for i, t in enumerate(texts)} | {(None, "a null key")}
    assert byte_bpe.encode(docs.where("doc_id > 9999"), vocabulary(), public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_small_tables_and_vocabularies(monkeypatch):
    """Any ranks over single bytes, tokens that merging never makes among them, and tables that overflow all the time."""
    rng = random.Random(8)
    for limit in (4, 1 << 19):
        monkeypatch.setattr(byte_bpe, "STATES", limit)
        monkeypatch.setattr(byte_bpe, "KNOWN", limit)
        for _ in range(40):
            ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
            for i in range(rng.randint(0, 25)):
                ranks.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))), 100 + i)
            ranks.update({bytes([b]): 1000 + b for b in range(256) if bytes([b]) not in ranks})
            lib = tiktoken.Encoding("own", pat_str=r"[a-c]+", mergeable_ranks=ranks, special_tokens={})
            machine = byte_bpe.Transducer(ranks)
            for _ in range(30):
                text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
                assert np.frombuffer(machine.encode(text.encode()), "<u4").tolist() == lib.encode_ordinary(text)


def test_transducer_looks_ahead_a_bounded_way():
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(vocabulary()))
    rng, state, pending = random.Random(3), machine.start, []
    for _ in range(20_000):
        state, _ = state[rng.choice(b"etaoin shrdlu")]
        pending.append(len(state.text))
    assert max(pending) < 64


def test_utf8_machine_at_every_cut():
    rng = random.Random(4)
    for _ in range(300):
        raw = b"".join(rng.choice([b"a", "é".encode(), "中".encode(), "😀".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f",
                                   b"\xc0\x80", b"\xed\xa0\x80", b"\x80"]) for _ in range(8))
        machine, text = byte_bpe.Utf8Machine(), ""
        for i in range(0, len(raw), 2):
            text += machine.feed(raw[i:i + 2])
            assert len(machine.held) <= 3
        assert text + machine.end() == raw.decode("utf-8", "replace")


def test_op11_over_a_table(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(vocabulary()),
                              special_tokens={})
    rows = op11_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


# --- periodic runs ----------------------------------------------------------------------------------------------------

def brute_runs(w, least=6, times=4):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - a >= max(least, times * p):
                found.setdefault((a, i + p - a), p)
    return sorted((a, n, p) for (a, n), p in found.items())


def test_runs_equal_all_periods():
    rng = random.Random(6)
    for _ in range(800):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randint(1, 5)
            w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < len(w) else x for i, x in enumerate(w)]
        for least, times in ((6, 4), (2, 2), (1, 3)):
            assert sorted(periodic_runs.find_runs(np.array([98, *w, 99]), least, times)) == \
                sorted((a + 1, n, p) for a, n, p in brute_runs(w, least, times))
    same = np.array([8] + [0] * 50_000 + [9])
    assert periodic_runs.find_runs(same) == [(1, 50_000, 1)]


def test_runs_of_documents(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_WORDS", 500)      # several documents in a slice, one alone in another
    monkeypatch.setattr(periodic_runs, "BLOCK", 64)
    monkeypatch.setattr(periodic_runs, "NODE_ITEMS", 97)
    rng = random.Random(9)
    texts = [None, "", " \n", "a", "x x x x x x", "x x x x x", "é b é b é b é b", "a a a a a a b b b b b b", "no break " * 4]
    for _ in range(60):
        w = [rng.choice("ab") * rng.randint(1, 2) for _ in range(rng.randint(1, 120))]
        a, p = rng.randrange(len(w)), rng.randint(1, 20)
        texts.append(rng.choice([" ", "\n\t", "  "]).join(w[:a] + [w[a + i % min(p, len(w) - a)] for i in range(len(w) - a)]))
    texts.append("long tail " * 2_000)
    docs = with_clashes(table(spark, list(enumerate(texts)) + [(None, texts[4]), (4, texts[4])]))
    got = periodic_runs.runs_of(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        w = WORDS.findall(texts[4 if r.doc_id is None else r.doc_id] or "")
        runs = brute_runs(w)
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == sorted(runs, key=lambda x: (x[0], x[2]))
        away = {i for a, n, p in runs for i in range(a + p, a + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in away)
    assert periodic_runs.runs_of(docs.where("doc_id > 9999")).count() == 0


def test_op12_over_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    made = {r.doc_id: WORDS.findall(r.text or "") for r in _made_periodic(docs).collect()}
    rows = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        w, h = WORDS.findall(t or ""), crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else w[j] for j in range(n)]
        assert made[i] == w
        runs = sorted(brute_runs(w), key=lambda x: (x[0], x[2])) if len(w) < 3_000 else None
        if runs is not None:
            best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
            assert (rows[i].n_runs, rows[i].start, rows[i].length, rows[i].period) == (len(runs), *best)
            lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
            assert rows[i].runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()


# --- spelling variants ------------------------------------------------------------------------------------------------

def brute_variants(counts, factor):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out = {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(close, default=None)
        out[w] = (n, len(close), best[1] if best and -best[0] >= factor * n else None)
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w] += (root,)
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(12)
    for alphabet, size in (("ab", 6), ("aàÿb", 4), ("a", 9)):
        counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, size))): rng.choice([1, 2, 5, 30, 400, 8000])
                  for _ in range(70)}
        got = spelling.variants(table(spark, list(counts.items()), "word string, n long"), factor=3).collect()
        want = brute_variants(counts, 3)
        assert len(got) == len(want)
        for r in got:
            n, n_near, form, root = want[r.word]
            assert (r.n, r.n_near, r.form, r.root, r.form_n) == (n, n_near, form, root, counts[form] if form else None)
    assert spelling.variants(table(spark, [], "word string, n long")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(table(spark, [], "word string, n long"), factor=1)


def test_rows_of_a_key_are_bounded(spark):
    """Many variants of one word meet in keys of at most one row a letter, and one more."""
    counts = {"planet": 10_000} | {"planet"[:i] + c + "planet"[i + 1:]: 2 for i in range(6) for c in "abcdefgh"}
    rows = spelling.rotations(table(spark, list(counts.items()), "word string, n long")).groupBy("key").count()
    assert rows.agg(F.max("count")).first()[0] <= 10


def test_op13_over_a_table(spark):
    counts = Counter()
    for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    rows = op13_spelling_variants(spark, SF).collect()
    assert {r.word: r.n for r in rows} == counts
    want = brute_variants(dict(list(sorted(counts.items()))), 10) if len(counts) < 6_000 else {}
    for r in rows if want else []:
        assert (r.n, r.n_near, r.form, r.root) == want[r.word]


# --- hashes, special strings, rows and names that collide ---------------------------------------------------------------

def thue_morse(n):
    """Two words that cancel out in every polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.fixture(scope="module")
def alike():
    return thue_morse(2048)


def test_hashes_do_not_cancel(alike):
    def hashes(words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        starts, ends, _ = find_words(raw, np.array([0, len(raw)]), space_words())
        return hash_words(raw, starts, ends)
    for n in (64, 512, 1024, 2048):
        assert len(set(hashes(thue_morse(n)).tolist())) == 2
    rng = random.Random(1)
    words = list({"".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 20))) for _ in range(20_000)})
    assert len(set(hashes(words).tolist())) == len(words)
    h = hashes([rng.choice("ab") for _ in range(3_000)])
    for k in (1, 2, 3, 5, 8, 10, 25, 50):
        windows = [tuple(h[i:i + k]) for i in range(len(h) - k + 1)]
        assert len(set(hash_windows(h, k).tolist())) == len(set(windows))
        assert len({*zip(windows, hash_windows(h, k).tolist())}) == len(set(windows))


def test_operators_tell_alike_words_apart(spark, alike):
    a, b = alike
    docs = table(spark, [(1, a), (2, b)])
    got = {r.doc_id: r.component_id for r in jaccard_join.near_groups(docs, 4, 85).collect()}
    assert got == {1: 1, 2: 2}
    many = table(spark, [(1, " ".join([a] * 50)), (2, " ".join([b] * 50))])
    assert {r.doc_id: r.kept_text for r in substring_dedup.cut_repeats(many).collect()} == \
        {1: " ".join([a] * 50), 2: " ".join([b] * 50)}
    leaks = decontaminate.find_leaks(docs, table(spark, [(7, a)], "item_id long, text string")).collect()
    assert {r.doc_id: r["items"] for r in leaks} == {1: [7], 2: []}
    model = brown_lm.fit(table(spark, [(1, a), (2, a), (3, "x y")]))
    known = {r.doc_id: r.n_known for r in brown_lm.score(docs, model).collect()}
    assert known == {1: 2, 2: 1}                                    # the end is known


def test_packing_keeps_the_tokenizers_ids(spark, alike):
    texts = [*alike, "hello <|endoftext|> world", "<|ENDOFTEXT|>a", "<|startoftext|>", "hello world", None]
    lib = Tokenizer.from_file(tokenizer_path())
    pieces = packing.token_pieces(table(spark, list(enumerate(texts))).coalesce(1), tokenizer_path(), 1 << 20).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pieces}
    for i, t in enumerate(texts):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (len(ids), crc32(ids.tobytes()))
    assert len(lib.encode(texts[2], add_special_tokens=False).ids) == 3


def test_copies_are_judged_row_by_row(spark):
    docs = with_clashes(table(spark, [(1, "A"), (5, "A"), (5, "B"), (6, "C"), (6, "C"), (None, "A"), (None, "D"), (None, "D"),
                                      (7, None), (8, ""), (9, " "), (10, "\n")]))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in left.collect()) == sorted(
        (i is None, i, t) for i, t in [(1, "A"), (5, "B"), (6, "C"), (None, "D"), (7, None), (9, " ")])
    assert exact_dedup.drop_copies(docs.where("doc_id > 99")).count() == 0


def test_leaks_in_blocks_and_rows(spark):
    words = [f"w{i}" for i in range(40)]
    items = table(spark, [(i, " ".join(words[i:i + 12])) for i in range(29)], "item_id long, text string")
    rows = [(1, " ".join(words)), (1, "nothing of it"), (1, " ".join(words)), (None, " ".join(words[5:30])), (2, None)]
    docs = with_clashes(table(spark, rows))
    show = lambda f: sorted(str((r.doc_id, r.n_words, r.spans, r["items"])) for r in f.collect())          # noqa: E731
    one, many = decontaminate.find_leaks(docs, items), decontaminate.find_leaks(docs, items, block_bytes=200)
    assert show(one) == show(many) and len(show(one)) == 5
    left = decontaminate.remove_leaks(docs, items, max_coverage=1.0)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(
        str(x) for x in [(1, ""), (1, "nothing of it"), (1, ""), (None, ""), (2, None)])
    assert decontaminate.remove_leaks(docs, items).count() == 2
    assert decontaminate.remove_leaks(docs.where("doc_id > 99"), items).count() == 0


def test_lines_go_beside_any_column(spark):
    docs = with_clashes(table(spark, [(1, "the same long line of words here\nalone"), (2, "the same long line of words here")]))
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {1: "the same long line of words here\nalone", 2: ""}
    assert line_dedup.drop_lines(docs.where("doc_id > 99")).count() == 0


# --- the class bigram and the language filters in plain Python -------------------------------------------------------------

def test_brown_scores_equal_plain_python(spark):
    import math
    rng = random.Random(21)
    vocab = [f"{a}{b}" for a in "klmnp" for b in ("ora", "ing", "eth", "u")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))                                      # noqa: E731
    train = [say(rng.randint(0, 30)) for _ in range(60)] + [None, "", "Kora KORA kora"]
    test = [say(rng.randint(0, 20)) for _ in range(20)] + [None, "", "unseen words here", "kora unseen kora"]
    model = brown_lm.fit(table(spark, list(enumerate(train))), classes=6, exchanges=3, unit_share=1e-9)

    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), None]

    def class_of(word):
        if word is None:
            return 0
        raw = np.frombuffer(word.encode(), np.uint8)
        h, group, _ = brown_lm._tokens(raw, np.array([0, len(raw)]))
        return int(model.classes[brown_lm._units(model.units, h, group)][0])

    of = {w: class_of(w) for t in (*train, *test) for w in tokens(t)}
    counts = Counter(w for t in train for w in tokens(t))
    follow = Counter()
    for t in train:
        before = 0
        for w in tokens(t):
            follow[before, of[w]] += 1
            before = of[w]
    mass = Counter()
    for w, n in counts.items():
        mass[of[w]] += n
    kinds = Counter(of[w] for w in counts)
    total, k, prior = sum(counts.values()), 6, 10.0
    share = {c: (mass[c] + 1) / (total + k) for c in range(k)}

    def logp(text):
        out, before = 0.0, 0
        for w in tokens(text):
            c = of[w]
            out += math.log10((follow[before, c] + prior * share[c]) / (sum(follow[before, x] for x in range(k)) + prior))
            out += math.log10((counts[w] + model.add) / (mass[c] + model.add * (kinds[c] + 1)))
            before = c
        return out

    rows = brown_lm.score(table(spark, list(enumerate(test))), model).collect()
    assert len(rows) == len(test)
    for r in rows:
        own = tokens(test[r.doc_id])
        assert r.score == pytest.approx(logp(test[r.doc_id]), rel=1e-9)
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in counts for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own))
    # after any word the known words and one unknown word of each class share the whole probability
    for before in range(k):
        whole = sum(10 ** (model.step[before, c] - model.spread[c]) * (
            sum(n + model.add for w, n in counts.items() if of[w] == c) + model.add) for c in range(k))
        assert whole == pytest.approx(1)


def test_language_filters_equal_plain_python(spark):
    from ridecast.llm import lang_id
    rng = random.Random(22)
    words = {"en": ["the", "of", "and", "Ship", "shore"], "de": ["der", "und", "Schiff", "für", "die"], "ru": ["и", "корабль", "море"]}
    docs = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 40))), lang)
            for i, lang in enumerate(rng.choice(list(words)) for _ in range(80))] + [(900, None, "en"), (901, "xx", None)]
    slots, share, contrast = 512, 0.004, 0.02
    f = lang_id.fit(table(spark, docs, "doc_id long, text string, lang string"), min_share=share, slots=slots, contrast=contrast)

    def grams(text):
        raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode()) + b" "
        raw = re.sub(b" +", b" ", raw)
        return [int.from_bytes(raw[i:i + 4], "little") for i in range(len(raw) - 3)]

    counts = {lang: Counter(g for _, t, x in docs if x == lang and t is not None for g in grams(t)) for lang in words}
    part = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    top = {g: max(p.get(g, 0) for p in part.values()) for p in part.values() for g in p}
    own = {lang: {g for g, s in p.items() if s >= share and s >= top[g] * contrast} for lang, p in part.items()}
    assert f.langs == sorted(words)

    def places(g):
        return [int(lang_id._slots(np.array([g]), k, slots)[0]) for k in range(f.probes)]

    bits = {lang: {s for g in own[lang] for s in places(g)} for lang in words}
    for i, lang in enumerate(f.langs):
        assert {s for s in range(slots) if int(f.masks[0][s]) >> i & 1} == bits[lang]
        assert f.false_rate[i] == pytest.approx((len(bits[lang]) / slots) ** f.probes)
    texts = [t for _, t, _ in docs[:30]] + ["Ship море der", "zzz qqq", "12 34", "", None, "a"]
    got = lang_id.predict(table(spark, list(enumerate(texts))), f).collect()
    for r in got:
        g = grams(texts[r.doc_id])
        shares = []
        for lang, rate in zip(f.langs, f.false_rate):
            hit = sum(all(s in bits[lang] for s in places(x)) for x in g) / max(len(g), 1)
            shares.append(min(max((hit - rate) / (1 - rate), 0), 1))
        if not re.search(r"[^\W\d_]", texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.score == pytest.approx(max(shares))
            if max(shares):
                assert r.lang_pred == f.langs[int(np.argmax(shares))]


def test_byte_bpe_keeps_frequent_pieces(monkeypatch):
    """A piece that keeps coming is encoded once, however many others pass through the table of known pieces."""
    from ridecast.llm import byte_bpe
    monkeypatch.setattr(byte_bpe, "KNOWN", 8)
    known = byte_bpe.Pieces(byte_bpe.Transducer({bytes((b,)): b for b in range(256)} | {b"th": 256, b"the": 257}))
    seen, encode = [], known.machine.encode
    monkeypatch.setattr(known.machine, "encode", lambda piece: seen.append(piece) or encode(piece))
    got = [known[p] for i in range(40) for p in ("the", f"x{i}")]
    assert seen.count(b"the") == 1 and len(seen) == 41 and len(known) + len(known.before) <= 8
    assert got[0] == got[78] == (257).to_bytes(4, "little") and got[79] == b"".join(b.to_bytes(4, "little") for b in b"x39")


# --- edit distances of lines: beginnings first ----------------------------------------------------------------------------

@pytest.mark.parametrize("beginning", [0.3, 1.0, 1.5, 4.0])
def test_beginnings_lose_no_pair(spark, monkeypatch, beginning):
    """Edits at either end, moved parts and unequal lengths, near the limit on both sides; any length of beginnings."""
    rng = random.Random(9)
    texts, pairs = [], []
    for size in (5, 12, 30, 80, 200):
        for _ in range(60):
            x = "".join(rng.choice("abcd é") for _ in range(size))
            y, k = list(x), max(1, round(size * rng.choice((0.1, 0.18, 0.2, 0.22, 0.3))))
            at = rng.choice((0, size - k, rng.randrange(size)))
            kind = rng.randrange(4)
            if kind == 0:
                del y[at:at + k]
            elif kind == 1:
                y[at:at] = [rng.choice("xyz") for _ in range(k)]
            elif kind == 2:                             # a part moved from one end to the other
                y = y[k // 2:] + y[:k // 2]
            else:
                for i in rng.sample(range(size), min(k, size)):
                    y[i] = "x"
            texts += [x, "".join(y)]
            pairs.append((len(texts) - 2, len(texts) - 1)[::rng.choice((1, -1))])

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
        return row[-1]

    near = {(a, b) for a, b in pairs if edits(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9}
    assert 60 < len(near) < len(pairs) - 60
    monkeypatch.setattr(line_dedup, "BEGINNING", beginning)
    codes = spark.createDataFrame(list(enumerate(texts)), "node long, code string")
    given = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in line_dedup._verified(given, codes, 0.8).collect()} == near


def test_long_lines_with_many_typos_meet(spark):
    """One character in ten replaced leaves few words whole; most such lines are near and must become candidates."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(2000)]
    lines = []
    for _ in range(60):
        text = " ".join(rng.choice(vocab) for _ in range(20))
        lines += [text, "".join(rng.choice("vwxyz") if c != " " and rng.random() < 0.1 else c for c in text)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in line_dedup.line_groups(docs, edits="characters").collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 120, 2)) >= 36


def test_frequent_pieces_are_counted_in_every_line(spark):
    """Documents of any id count, and no piece is left out because many others are frequent, too."""
    ids = [r["id"] for r in spark.range(4000).where("pmod(xxhash64(id), 16) <> 0").limit(300).collect()]
    docs = spark.createDataFrame([(i, f"ab{chr(97 + n % 26)}{chr(97 + n // 26)} always the same end") for n, i in enumerate(ids)],
                                 "doc_id long, text string")
    lines = line_dedup.hashed_lines(docs)
    counts = {}
    for r in lines.collect():
        for h in (r["short"] or []) + (r["grams"] or []) + (r["starts"] or []):
            counts[h] = counts.get(h, 0) + 1
    expected = {h: (c // 8).bit_length() for h, c in counts.items() if c >= 8}
    assert expected and line_dedup.frequent_pieces(lines) == expected
    last = {h for h, c in counts.items() if c == len(ids)}
    for r in line_dedup.sketches(lines, expected).collect():
        times = [h >> line_dedup.HASH_BITS for h in r["grams"]]
        assert times == sorted(times) and all(h >> line_dedup.HASH_BITS for h in r["grams"] if h & (1 << line_dedup.HASH_BITS) - 1 in last)


def test_word_alignments_bound_the_edit_distance(spark):
    """The numbers that settle near pairs early are never below the distance, and close to it for words removed or put in."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    rows = []
    for n in range(150):
        x = [rng.choice(vocab) for _ in range(rng.randint(2, 30))]
        y = list(x)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(y))
            y[at:at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0 if len(y) > 3 else 1, 2)
        rows.append((" ".join(x), " ".join(y)))
    far = [f"w{i}" for i in range(60)]
    rows.append((" ".join(far), " ".join(w for i, w in enumerate(far) if i % 10)))      # six words gone, one after the other
    pairs = spark.createDataFrame(rows, "x string, y string").selectExpr("x", "y", "split(x, ' ') as s", "split(y, ' ') as t")
    got = pairs.selectExpr("x", "levenshtein(x, y) as d", f"{line_dedup._aligned('s', 't')} as aligned",
                           f"{line_dedup._word_edits('s', 't')} as counted").collect()
    assert all(r["aligned"] >= r["d"] and r["counted"] >= r["d"] for r in got)
    drifted = [r for r in got if r["x"] == rows[-1][0]]
    assert [r["aligned"] for r in drifted] == [r["d"] for r in drifted]
