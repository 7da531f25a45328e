import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import align, langid, leaks, overlap, packing, sentences, tokens
from corpusloom.llm.common import fold
from corpusloom.llm.rolling import Prints, codes

PAIR = "rec_id long, split string, text_src string, meta_corpus string, folded string, cid long, e long, t long, h long"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@given(st.text("abc", max_size=24), st.text("abc", max_size=24), st.integers(0, 8))
@settings(max_examples=300, deadline=None)
def test_bounded_distance(a, b, k):
    assert overlap.distance_at_most(a, b, k) == min(edit(a, b), k + 1)


@given(st.text(min_size=1, max_size=60), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_window_prints_depend_on_content_only(x, q):
    a, b = codes(x), codes("zz" + x)
    assert list(Prints(a).windows(q)) == list(Prints(b).windows(q))[2:] or len(a) < q


def test_cross_split_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12, 120))) for _ in range(25)]

    def noisy(t, n):
        t = list(t)
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(alphabet)
        return "".join(t)

    rows, i = [], 0
    for t in base:
        for s, x in (("train", t), ("test", noisy(t, len(t) // 16)), ("valid2", "。".join([t[:5], t[5:]]) + " "), ("train", noisy(t, len(t) // 3))):
            rows.append((i, s, x, "c", "clash", 1, 1, 1, 1))
            i += 1
    rows += [(9001, None, base[0], None, "", 1, 1, 1, 1), (9002, "test", None, None, "", 1, 1, 1, 1), (9003, "test", "。。", None, "", 1, 1, 1, 1), (9004, "train", "", None, "", 1, 1, 1, 1), (9005, "test", "long" * 3000, None, "", 1, 1, 1, 1), (9006, "train", "long" * 3000 + "!", None, "", 1, 1, 1, 1), (None, "test", base[0], None, "", 1, 1, 1, 1)]
    d = spark.createDataFrame(rows, PAIR)
    want = set()
    live = [(r[0], r[1], fold(r[2])) for r in rows if r[0] is not None and r[1] and r[2] and fold(r[2])]
    for a, sa, x in live:
        for b, sb, y in live:
            if sa == "train" and sb != "train" and max(len(x), len(y)) < 5000 and edit(x, y) <= int(overlap.WRONG * max(len(x), len(y))):
                want.add((min(a, b), max(a, b)))
    want.add((9005, 9006))
    got = [tuple(r) for r in overlap.cross_split(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap.cross_split(d.limit(0)).count() == 0
    rep = overlap.overlap_report(d).collect()
    assert sum(r.records for r in rep) == sum(1 for r in rows if r[1] and r[1] != "train")


def test_cross_split_at_one_error_in_ten(spark):
    rng = random.Random(5)
    scripts = {"latin": [chr(97 + i) for i in range(26)], "hangul": [chr(0xAC00 + 7 * i) for i in range(600)], "han": [chr(0x4E00 + i) for i in range(2000)]}
    rows, want = [], set()
    for letters in scripts.values():
        for n in (10, 20, 30, 50, 85, 200, 445):
            for _ in range(6):
                t = [rng.choice(letters) for _ in range(n)]
                x = t[:]
                for i in rng.sample(range(n), n // 10):
                    x[i] = rng.choice(letters) if rng.random() < 0.6 else rng.choice(("", x[i] + rng.choice(letters)))
                want.add((len(rows), len(rows) + 1))
                rows += [(len(rows), "train", "".join(t), "c", "", 1, 1, 1, 1), (len(rows) + 1, "test", "".join(x), "c", "", 1, 1, 1, 1)]
    near = {p for p in want if edit(rows[p[0]][2], rows[p[1]][2]) <= int(overlap.WRONG * max(len(rows[p[0]][2]), len(rows[p[1]][2])))}
    assert len(near) > 0.9 * len(want)
    got = {tuple(r) for r in overlap.cross_split(spark.createDataFrame(rows, PAIR)).collect()}
    assert near <= got


def test_cross_split_of_many_variants(spark):
    rng = random.Random(6)
    rows = []
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 40), ("".join(chr(0xAC00 + 7 * i) for i in range(300)), 27)):
        base = [rng.choice(letters) for _ in range(n)]
        for k in range(46):
            t = base[:]
            t[k % n] = rng.choice(letters)
            rows.append((len(rows), "train" if k % 2 else "test", "".join(t), "c", "", 1, 1, 1, 1))
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if a // 46 == b // 46 and (a - b) % 2}
    assert {tuple(r) for r in overlap.cross_split(spark.createDataFrame(rows, PAIR)).collect()} == want


def scanned(evaluation, training):
    """Pairs (e, t) that the automaton of one shard over all passages finds in the training texts."""
    frame = lambda x, first: pd.DataFrame({"cid": range(first, first + len(x)), "folded": x})
    one = type("Value", (), {})
    one.value = np.zeros(1 << overlap.RARITY_BITS, dtype=np.int64)
    p = pd.concat(overlap._passages(one)(iter([frame(evaluation, 0)])))
    one.value = np.zeros(1 << (overlap.KNOWN_BITS - 3), dtype=np.uint8)
    bit = p["bit"].to_numpy()
    np.bitwise_or.at(one.value, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    s = pd.concat(overlap._stretches(one)(iter([frame(training, len(evaluation))])))
    keys = set(p["key"])
    found = [overlap.Shard(p[p["key"] == k]).scan(s[s["key"] == k]) for k in keys if (s["key"] == k).any()]
    return {(e, t - len(evaluation)) for f in found for e, t in zip(f["e"], f["t"], strict=True)}


def test_no_pair_within_the_bound_is_missed_by_shards():
    rng = random.Random(7)
    evaluation, training = [], []
    for n in [*range(8, 80), 120, 300]:
        for last in (0, 1):
            k = int(overlap.WRONG * n)
            e = [rng.choice("abcdefgh") for _ in range(n)]
            t = e[:]
            step = n / (k + 1)
            for i in range(1, k + 1):  # an edit every few letters, as evenly as they go
                t[int(i * step) - last] = rng.choice(["z", "", t[int(i * step) - last] + "z"])
            t = "".join(t)
            if edit("".join(e), t) <= int(overlap.WRONG * max(n, len(t)) + 1e-9):
                evaluation.append("".join(e))
                training.append(t)
    assert len(evaluation) > 100
    assert {(i, i) for i in range(len(evaluation)) if evaluation[i] != training[i]} <= scanned(evaluation, training)
    for e, t in zip(evaluation, training, strict=True):
        assert len(next(overlap._verify(iter([pd.DataFrame({"e": [1], "t": [2], "e_text": [e], "t_text": [t], "coverage": [0.5]})])))) == 1


def test_hot_fingerprints_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(30))
    rows = []
    for k in range(60):
        t = list(base)
        t[k % 30] = rng.choice("qrst")
        rows.append((len(rows), "train" if k % 2 else "test", "".join(t) + "uvwxyz"[k % 6], "c", "", 1, 1, 1, 1))
    d = spark.createDataFrame(rows, PAIR)
    whole = {tuple(r) for r in overlap.cross_split(d).collect()}
    monkeypatch.setattr(overlap, "HOT", 1)
    monkeypatch.setattr(overlap, "SHARD", 2)
    assert {tuple(r) for r in overlap.cross_split(d).collect()} == whole
    assert len(whole) == 900


def test_unigram_counts(spark):
    u = tokens.Unigram({"▁": -2.0, "a": -3.0, "ab": -1.0, "▁ab": -0.5, "c": -2.0, "。": -1.0})
    assert u.count("ab ab") == 2 and u.count("abc。") == 3 and u.count("") == 0 and u.count("zz") == 3 and u.count(" \n") == 0
    whole = lambda t: u.length("▁" + "▁".join(t.split()))
    for t in ("ab c。ab", "a b c", "cab。zab"):
        assert u.count(t) == whole(t)  # pre-splitting changes nothing
    d = spark.createDataFrame([(1, "ab ab", "c"), (2, None, "c"), (3, " ", "c"), (4, "ab ab ab", "c"), (None, "ab", "c"), (5, "c" * 20_000, "c")], "text_id long, text string, piece string")
    assert {r.text_id: r.tokens for r in tokens.token_counts(d, "text_id", "text", u).collect()} == {1: 2, 2: 0, 3: 0, 4: 3, 5: 20_001}
    assert tokens.token_counts(d.limit(0), "text_id", "text", u).count() == 0


def test_bpe_pieces_give_exact_totals(spark):
    b = tokens.ByteBpe()
    for t in ("Hello, world! It's 3.5  ok", "朝鮮王朝實錄。甲乙", "  a\n\nb", "한국어 문장이다.", ""):
        assert "".join(b.pieces(t)) == t
        assert sum(b.length(p) for p in b.pieces(t)) == b.count(t)


def test_packing_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        cap = rng.randrange(5, 60)
        counts = {}
        for _ in range(rng.randrange(1, 60)):
            s = rng.randrange(1, cap + 1)
            counts[s] = counts.get(s, 0) + 1
        pat = packing.pack_sizes(counts, cap)
        used = {}
        for m, parts in pat:
            assert m > 0 and sum(s * k for s, k in parts) <= cap
            for s, k in parts:
                used[s] = used.get(s, 0) + m * k
        assert used == counts
        n, total = sum(m for m, _ in pat), sum(s * c for s, c in counts.items())
        assert n <= max(-(-total // cap) * 11 / 9 + 2, 1)
    assert packing.pack_sizes({}, 10) == []
    assert packing.pack_sizes({6: 2, 4: 2}, 10) == [(2, ((6, 1), (4, 1)))]


def test_translation_table_has_every_token_of_every_record(spark, monkeypatch):
    han, ko = [chr(0x4E00 + i) for i in range(2600)], [chr(0xAC00 + i) for i in range(2600)]
    rows = [(i, han[i % 2600] + "。", ko[i % 2600] + ".", None) for i in range(13_000)]
    d = spark.createDataFrame(rows, "rec_id long, text_hj string, side string, text_en string").repartition(2)
    d = d.mapInPandas(align._read("oko"), f"rec_id long, {align._SIDE.format('h')}, {align._SIDE.format('k')}")
    for cells in (align.CELLS, 1):  # all cells; only those that occur
        monkeypatch.setattr(align, "CELLS", cells)
        lex = align.estimate(d, rounds=2)
        assert lex.n_src == len({fold(c) for c in han} - set("〇一二三四五六七八九十百千")) and lex.n_tgt == 2600
        assert all(align.link_lines(align.text_lines(h, "hj"), align.text_lines(s, "oko"), lex) == [(0, 0)] for _, h, s, _ in rows[:2600] if align.tokens(h, "hj")[0])


def test_fill_containers(spark):
    rows = [(i, "word " * (i % 7 * 10 + 1), 1, 1, "x") for i in range(200)] + [(300, "long " * 500, 1, 1, "x"), (301, None, 1, 1, "x"), (302, "", 1, 1, "x"), (None, "x", 1, 1, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, tokens int, size int, full string")
    spec = spark.createDataFrame([(1, 64), (2, 100), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    got = packing.fill_containers(d, spec).collect()
    size = {r[0]: tokens.ByteBpe().count(r[1]) for r in rows if r[0] is not None and r[1]}
    for s, cap in ((1, 64), (2, 100)):
        mine = [r for r in got if r.spec_id == s]
        fill, docs = {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            docs[r.doc_id] = docs.get(r.doc_id, 0) + r.tokens
        assert max(fill.values()) <= cap and docs == size
        assert all(sum(x.doc_id == i for x in mine) == 1 for i in size if size[i] <= cap)
    assert packing.fill_containers(d.limit(0), spec).count() == 0 and packing.fill_containers(d, spec.limit(0)).count() == 0


def learned(texts):
    from collections import Counter

    c = Counter()
    for t in texts:
        sentences.observe(t, c)
    return sentences.Model(dict(sentences.hashed(c)))


def cut(t, m):
    e = sentences.ends(t, m)
    return [t[a:b].strip() for a, b in zip([0, *e[:-1]], e, strict=True)]


def test_sentences():
    m = learned(["The dike broke. It was mended.\nThe king heard. He was glad."] * 30 + ["甲乙丙丁。戊己庚辛。"] * 30)
    assert cut("Dr. Kim paid 3.5 nyang. He left.", m) == ["Dr. Kim paid 3.5 nyang.", "He left."]
    assert cut('"Is it full? Then seal it!" said Kim. He left.', m) == ['"Is it full? Then seal it!" said Kim.', "He left."]
    assert cut("對曰「臣不敢。臣請退。」遂出。甲乙。", m) == ["對曰「臣不敢。臣請退。」遂出。", "甲乙。"]
    assert cut("○甲乙。○丙丁", m) == ["○甲乙。", "○丙丁"]
    assert cut("쌀값이 1.1냥으로 올랐다.그가 갔다.", m) == ["쌀값이 1.1냥으로 올랐다.", "그가 갔다."]
    assert cut("甲乙丙丁矣戊己庚辛焉", m) == ["甲乙丙丁矣", "戊己庚辛焉"]
    assert sentences.ends("", m) == [] and sentences.ends(" \n", m) == [] and sentences.ends("。", m) == [1]


def test_long_lists_and_speech_are_one_sentence():
    m = learned(["The dike broke. It was mended."] * 30 + ["甲乙丙丁。戊己庚辛。"] * 30)
    for n in (5, 12, 200):
        for long, last in (("米　布　鐵　" * n + "。", "甲乙丙丁。"), ("米 布 鐵 " * n + "。", "甲乙丙丁。"), ('He said "' + "no! no! " * n + '" and left.', " He went.")):
            assert sentences.ends(long + last, m) == [len(long), len(long + last)]


@given(st.text(st.sampled_from("ab甲가あ。.!?「」\"' \n　○矣…"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_sentence_ends_rise_and_reach_the_end(t):
    e = sentences.ends(t, sentences.Model({}))
    assert e == sorted(set(e)) and (not t.strip()) == (not e)
    if e:
        assert e[-1] == len(t.rstrip()) and all(not t[x - 1].isspace() for x in e)


def test_sentence_ends_query(spark):
    d = spark.createDataFrame([(1, "甲乙。丙丁。", "x"), (2, None, "x"), (3, " ", "x"), (None, "甲。", "x"), (4, "字" * 100_000 + "。", "x")], "text_id long, text string, end_at string")
    assert {tuple(r) for r in sentences.sentence_ends(d).collect()} == {(1, 3), (1, 6), (4, 100_001)}
    assert [(r.sent_no, r.start_at, r.sentence) for r in sentences.sentences(d).where("text_id = 1").orderBy("sent_no").collect()] == [(0, 0, "甲乙。"), (1, 3, "丙丁。")]
    assert sentences.sentence_ends(d.limit(0)).count() == 0


def test_sentences_of_other_scripts(spark):
    cases = {
        "hi": ["यह पहला वाक्य है।", "क्या यह दूसरा वाक्य है?", "तीसरा वाक्य ३.५ किलो का है।"],
        "ar": ["هذه هي الجملة الأولى.", "هل هذه هي الجملة الثانية؟", "نعم، هذه الثالثة."],
        "ur": ["یہ پہلا جملہ ہے۔", "کیا یہ دوسرا ہے؟"],
        "my": ["ဤသည်မှာ ပထမဝါကျ ဖြစ်သည်။", "ဒုတိယ ဝါကျ ဖြစ်သည်။"],
        "am": ["ይህ የመጀመሪያው ዓረፍተ ነገር ነው።", "ሁለተኛው ይህ ነው።"],
        "ru": ["Это первое предложение.", "Это второе предложение?", "Третье стоит 3.5 рубля."],
    }
    rows = [(i, " ".join(s)) for i, s in enumerate(cases.values())]
    want = set()
    for i, s in enumerate(cases.values()):
        at = 0
        for x in s:
            at += len(x)
            want.add((i, at))
            at += 1
    assert {tuple(r) for r in sentences.sentence_ends(spark.createDataFrame(rows, "text_id long, text string")).collect()} == want


def test_tiling_covers_like_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        a = "".join(rng.choice("abcd") for _ in range(30))
        b = "".join(rng.choice("abcd") for _ in range(20)) + a[5:20] + "x" + a[20:28]
        got = leaks.tiles(codes(a), codes(b), 4)
        assert all(a[i : i + n] == b[j : j + n] and n >= 4 for i, j, n in got)
        longest = max(n for i in range(30) for j in range(len(b)) for n in [next((k for k in range(31) if i + k >= 30 or j + k >= len(b) or a[i + k] != b[j + k]), 0)])
        assert max(n for _, _, n in got) == longest
        for s in (0, 1):
            covered = [x for t in got for x in range(t[s], t[s] + t[2])]
            assert len(covered) == len(set(covered))


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [word(120) for _ in range(6)]
    other = lambda: word(200)
    wrong = items[0][:30] + "。 " + "錯" + items[0][31:]
    docs = [(1, other() + wrong + other()), (2, items[1][60:] + other() + items[1][:60]), (3, other() + items[2][:20]), (4, items[3][:35] + other() + items[3][35:70]), (5, None), (6, ""), (7, other() * 300 + items[4]), (None, items[0]), (8, items[5][:20] + other() + items[5][40:60] + other() + items[5][80:100])]
    d = spark.createDataFrame([(*x, 1.0, 2) for x in docs], "doc_id long, text string, coverage double, item_id int")
    it = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (92, items[0]), (None, items[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, it).collect()}
    assert got == {(1, 0), (1, 92), (2, 1), (4, 3), (7, 4)}
    assert leaks.leaked_items(d, it.limit(0)).count() == 0 and leaks.leaked_items(d.limit(0), it).count() == 0


def test_leaks_do_not_depend_on_the_other_items(spark):
    rng = random.Random(12)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    item = word(160)
    twins = [item[:52] + word(100) for _ in range(5)]
    docs = [(1, word(200) + item[:52] + word(150) + item[90:126] + word(90)), (2, word(300) + item[:52])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    alone = spark.createDataFrame([(7, item)], "item_id long, text string")
    among = spark.createDataFrame([(7, item), *((100 + i, t) for i, t in enumerate(twins)), (300, "甲乙")], "item_id long, text string")
    for it in (alone, among):
        for most in (10**6, 0):  # broadcast seeds; joined seeds
            assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, it, most=most).collect()} == {(1, 7)}


def test_ppm_code_lengths_are_exact():
    m = langid.Trees({"en": ["abab abab"], "ko": ["가나가나"]}, order=2)
    b = "abz".encode()
    import numpy as np

    got = m.code_lengths(np.frombuffer(b, dtype=np.uint8), np.array([0]))[0]

    def slow(text, data, order):
        total, data = 0.0, data + b"\n"
        pad = b"\0" * order
        for i in range(len(text)):
            hist = (pad + text)[i : i + order]
            bits = 0.0
            for k in range(order, -1, -1):
                ctx = hist[order - k :]
                seen = [(pad + data)[j + order] for j in range(len(data)) if (pad + data)[j + order - k : j + order] == ctx]
                if not seen:
                    continue
                c, dist = seen.count(text[i]), len(set(seen))
                if c:
                    bits += -np.log2(c / (len(seen) + dist))
                    break
                bits += -np.log2(dist / (len(seen) + dist))
            else:
                bits += 8
            total += bits
        return total

    for j, t in enumerate(("가나가나", "abab abab")):
        assert m.langs[j] == ("ko", "en")[j] and got[j] == pytest.approx(slow(b, t.encode(), 2), rel=1e-4)


def test_languages(spark):
    en, ko, hj = "The dike was mended by the men of the town. ", "둑을 고치고 사람들이 돌아갔다. ", "修堤而還命旌其門。"
    rows = [(i, en * 3, "en") for i in range(20)] + [(100 + i, ko * 3, "ko") for i in range(20)] + [(200 + i, hj * 4, "hj") for i in range(20)]
    rows += [(301, en * 4, "ko"), (302, en * 4, None), (303, en * 4, "en-US"), (304, ko * 4 + "\n" + en * 4, "ko"), (305, hj * 6, "lzh"), (306, None, "ko"), (307, "", None), (308, " ", None), (None, en, "ko"), (309, en * 3000, "xx")]
    d = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, lang string, start_at int, main string")
    got = {tuple(r) for r in langid.mislabelled(d).collect()}
    assert got == {(301, 0, "en"), (302, 0, "en"), (304, 0, "ko"), (304, len(ko * 4) + 1, "en"), (309, 0, "en")}
    assert all(0 < r.confidence <= 1 for r in langid.stretches(d).collect())
    assert langid.stretches(d.limit(0)).count() == 0


def test_numerals_and_alignment(spark):
    assert [align.han_number(x) for x in ("千四百十九", "七千七百六十五", "三", "二〇一", "十")] == [1419, 7765, 3, 201, 10]
    hj = ["雲松驛進白米{}石。", "鶴里橋壞發丁{}名。", "浦人得白鹿{}頭獻之。"]
    ko = ["운송역에서 쌀 {}석을 바쳤다.", "학리의 다리가 무너져 장정 {}명을 내었다.", "포구 사람이 흰 사슴 {}마리를 바쳤다."]
    nums = [("三千二百十一", 3211), ("四百五", 405), ("六千七", 6007)]
    rng = random.Random(7)
    rows = []
    for i in range(60):
        k = rng.sample(range(3), 3)
        a = [hj[x].format(nums[(x + i) % 3][0]) for x in range(3)]
        b = [ko[x].format(nums[(x + i) % 3][1]) for x in k]
        rows.append((i, "\n".join(a), "\n".join(b), None, k))
    d = spark.createDataFrame([r[:4] for r in rows] + [(900, None, "x", None), (901, "甲", None, None), (902, "", "", ""), (903, "甲\n\n乙", "\n", "a\nb"), (None, "甲", "갑", None)], "rec_id long, text_hj string, text_oko string, text_en string")
    got = {tuple(r) for r in align.aligned_lines(d).collect()}
    want = {(r[0], "oko", x, r[4].index(x)) for r in rows for x in range(3)}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.1 * len(want)
    assert align.aligned_lines(d.limit(0)).count() == 0


def test_blocks_of_lines_read_as_single_lines():
    rng = random.Random(11)
    some = ["甲", "三百", "〇", "二〇一", "(註)", "〔", "]", "為", "Ａ", "⼀", "é", "운송", "나", "3,211", "٣", ",", "，", " ", "　", "\n", "\n", "Jiga-ju", "İstanbul", "X", "Before", "a_b", "1" * 4400, "\x1c", "."]
    texts = ["", "\n", *("".join(rng.choices(some, k=rng.randrange(1, 30))) for _ in range(300))]
    for side in ("hj", "oko", "en"):
        got = align.read_lines(texts, side)
        assert got["t"].tolist() == [len(t.split("\n")) for t in texts]
        lines = [x for t in texts for x in t.split("\n")]
        words, nums = np.split(np.c_[got["w"][got["c"]], got["n"]], np.cumsum(got["l"])[:-1]), np.split(got["x"], np.cumsum(got["xl"])[:-1])
        for x, w, n, f in zip(lines, words, nums, got["f"].tolist(), strict=True):
            toks, numbers = align.tokens(x, side)
            ids = [align.token_id(t) for t in toks]
            assert dict(w.tolist()) == {i: ids.count(i) for i in ids}
            assert n.tolist() == sorted({v for v in numbers if v < 1 << 62})
            assert f == bool(x.strip()) + 2 * (x.rstrip()[-1:] in (",", "，"))
    assert len(align.read_lines(["一" * 5000], "hj")["x"]) == 0  # a numeral too long for a number ends nothing
    d = pd.DataFrame({"rec_id": range(9000), "text_hj": "甲\n乙", "side": "갑\n을"})
    assert len(pd.concat(align._read("oko", 3000)(iter([d])))) == 3  # a row a block, not a record


def test_counts_by_products_and_by_cells_agree():
    rng = random.Random(12)
    han, ko = [chr(0x4E00 + 7 * i) for i in range(60)], [chr(0xAC00 + 7 * i) for i in range(90)]
    text = lambda x: "\n".join("".join(rng.choices(x, k=rng.randrange(0, 12))) for _ in range(rng.randrange(1, 7)))
    d = pd.DataFrame({"rec_id": range(300), "text_hj": [text(han) for _ in range(300)], "side": [text(ko) for _ in range(300)]})
    blocks = pd.concat(align._read("oko", 50)(iter([d])))
    src, tgt = (np.unique(np.concatenate([b[c]["w"] for b in align._blocks(iter([blocks]))])) for c in (0, 1))
    t = np.random.default_rng(1).random(len(src) * len(tgt)).astype(np.float32) + np.float32(0.01)
    value = lambda x: type("Value", (), {"value": x})
    # One line's cells after another.
    want = np.zeros((len(tgt), len(src)))
    at_h, at_k = {w: i for i, w in enumerate(src.tolist())}, {w: i for i, w in enumerate(tgt.tolist())}
    by_pair, words = t.reshape(len(tgt), len(src)).astype(np.float64), {"k": {}}
    for h, k in zip(d["text_hj"], d["side"], strict=True):
        a, b = ([align.tokens(x, s)[0] for x in y.split("\n")] for y, s in ((h, "hj"), (k, "oko")))
        for i, x in enumerate(a):
            place = (i + 0.5) * len(b) / len(a)
            near = [c for y in b[max(0, int(place - 1.3)) : min(len(b), int(place + 1.3) + 1)] for c in y]
            for c in set(near):
                words["k"][ord(c)] = words["k"].get(ord(c), 0) + 1
            hs = [at_h[ord(c)] for c in x]
            for c in near:
                if hs:
                    w = by_pair[at_k[ord(c)], hs]
                    np.add.at(want[at_k[ord(c)]], hs, w / w.sum())
    for dense in ([], range(0, len(tgt), 2), range(len(tgt))):
        for cells in (None, np.arange(len(t))) if not len(dense) else (None,):
            got = np.zeros(len(t))
            for part in align._expect(value(t), value((src, tgt, cells, np.array(dense, dtype=np.int64))))(iter([blocks])):
                for block, c in zip(part["block"], part["c"], strict=True):
                    c = np.frombuffer(c, dtype=np.float32)
                    got[block * align._BLOCK : block * align._BLOCK + len(c)] += c
            assert np.allclose(got, want.reshape(-1), rtol=1e-3, atol=1e-5)
    seen = pd.concat(align._count_tokens(iter([blocks]))).groupby(["side", "w"])["n"].sum()
    assert {w: n for w, n in seen["k"].items() if w != -1} == words["k"]


def maps(passages):
    """The bit maps of start windows and of start windows by size and place."""
    out = []
    for c, bits in (("bit", overlap.KNOWN_BITS), ("near", overlap.NEAR_BITS)):
        one, bit = np.zeros(1 << (bits - 3), dtype=np.uint8), passages[c].to_numpy()
        np.bitwise_or.at(one, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        out.append(type("Value", (), {"value": one}))
    return out


def test_stretches_only_where_size_and_place_allow_a_pair():
    rng = random.Random(13)
    frame = lambda x, first: pd.DataFrame({"cid": range(first, first + len(x)), "folded": x})
    rarity = type("Value", (), {"value": np.zeros(1 << overlap.RARITY_BITS, dtype=np.int64)})
    evaluation, training, edits = [], [], lambda n: int(overlap.WRONG * n + 1e-9)
    for n in [*range(8, 130), 300, 1000]:
        e = "".join(rng.choices("abcdefgh", k=n))
        for where in range(4):  # all edits in front, behind, or spread; letters put in, taken out or changed
            k = rng.randrange(1, edits(n) + 1) if edits(n) else 0
            t = list(e)
            for i in range(k):
                x = (0, len(t) - 1, rng.randrange(len(t)), i * n // (k + 1))[where]
                t[x : x + 1] = rng.choice(([], ["z", *t[x : x + 1]], ["y"]))
            evaluation.append(e)
            training.append("".join(t))
    p = pd.concat(overlap._passages(rarity)(iter([frame(evaluation, 0)])))
    known, near = maps(p)
    s = pd.concat(overlap._stretches(known, near)(iter([frame(training, len(evaluation))])))
    keys = set(p["key"]) & set(s["key"])
    found = pd.concat([overlap.Shard(p[p["key"] == k]).scan(s[s["key"] == k]) for k in keys])
    found = {(e, t - len(evaluation)) for e, t in zip(found["e"], found["t"], strict=True)}
    close = lambda e, t: edit(e, t) <= edits(max(len(e), len(t)))
    assert {i for i, (e, t) in enumerate(zip(evaluation, training, strict=True)) if e != t and len(e) < 200 and overlap.most_edits(len(e)) and close(e, t)} <= {e for e, t in found if e == t}
    # A phrase of an evaluation text far from its place, or in a much longer text, is shipped nowhere.
    phrase, rest = "".join(chr(0x4E00 + i) for i in range(60)), ["".join(chr(0x5000 + 80 * x + i) for i in range(80)) for x in range(20)]
    p = pd.concat(overlap._passages(rarity)(iter([frame([phrase + rest[0]], 0)])))
    known, near = maps(p)
    elsewhere = frame([rest[1] + phrase, phrase + "".join(rest[1:])], 1)
    assert len(pd.concat(overlap._stretches(known)(iter([elsewhere])))) > 10
    assert not list(overlap._stretches(known, near)(iter([elsewhere])))
