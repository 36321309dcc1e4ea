import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spotloom.llm import canonical, leaks, tokens

read = canonical.read_signs


def test_what_reads_alike():
    for a, b in [("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("é", "é"), ("so­ft​ ⁠x﻿", "soft x"), ("a b c\td", "a b c d"), ("Ваnаnа", "Banana"), ("Κν", "Kv"), ("K", "K"), ("a‑b‐c", "a-b-c"), ("ﬁ ﬀ", "fi ff"), ("⼈", "人"), ("Ⅳ", "IV"), ("ĳ", "ij"), ("e‍́", "é"), ("ё", "ё"), ("ё", "ë"), ("й", "й")]:
        assert read(a) == read(b), (a, b)
    for a, b in [("é", "e"), ("A", "a"), ("①", "1"), ("m²", "m2"), ("й", "и"), ("–", "-"), ("a b", "a  b"), ("½", "1/2"), ("ſ", "s"), ("ϑ", "θ")]:
        assert read(a) != read(b), (a, b)
    assert read("​﻿") == "" and read("") == ""


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_reading_is_settled(t):
    assert read(read(t)) == read(t)
    assert read(unicodedata.normalize("NFD", t)) == read(t) == read(unicodedata.normalize("NFC", t))


@settings(max_examples=200, deadline=None)
@given(st.text("abcАВСаеорKн é​", max_size=20), st.text("abcАВСаеорKн é​", max_size=20))
def test_spelling_never_changes_what_is_equal(a, b):
    trie = canonical.SpellingTrie([("нос", 3), ("ворон", 2), ("осень", 1), ("сено", 5)])
    ca, cb = canonical.canonical_text(a, trie), canonical.canonical_text(b, trie)
    assert (ca == cb) == (read(a) == read(b))
    assert read(ca) == read(a)


def test_vocabulary_gives_the_spelling():
    trie = canonical.SpellingTrie([("сено", 5), ("côté", 4)])
    form = lambda t: canonical.canonical_text(t, trie)
    assert form("cено!") == "сено!" == form("сено\u200b!") and form("co\u0302té") == "côté" and form("Ваna") == "Bana"


def test_raw_tokens_walk_the_trie(monkeypatch):
    """The automaton gets each token as it stands; what it accepts is not put through the table."""
    seen = []
    spell = canonical.SpellingTrie.spell
    monkeypatch.setattr(canonical.SpellingTrie, "spell", lambda self, t: seen.append(t) or spell(self, t))
    trie = canonical.SpellingTrie([("сор", 3), ("cat", 2), ("сорока", 1)])
    raw = "ｃ\u200bоp copoкa c\u00adat ﬁn"
    assert canonical.canonical_text(raw, trie) == "сор сорока cat fin"
    assert seen == ["ｃ\u200bоp", "copoкa", "c\u00adat", "ﬁn"]
    # two spellings of different scripts share a shape: both are alive until the next sign
    assert len(trie.edges[0]["c"]) == 2 and spell(trie, "cop") == spell(trie, "сор") == "сор" and spell(trie, "cat") == "cat" and spell(trie, "ca") is None
    # without the automaton the table alone decides, and gives another form
    monkeypatch.setattr(canonical.SpellingTrie, "spell", lambda self, t: None)
    assert canonical.canonical_text(raw, trie) == "cop сорока cat fin"


def test_other_edits_weigh_one():
    words = [("сорока", 3), ("ворон", 2)]
    for token, near in (("copoкa", "сорока"), ("copкa", "сорока"), ("coporкa", "сорока"), ("cozoкa", "сорока"), ("opoкa", "сорока"), ("ворон\u200bx", "ворон"), ("вopoн", "ворон"), ("вxpxн", None), ("", None)):
        assert canonical.SpellingTrie(words, 1).spell(token) == near, token
        assert canonical.SpellingTrie(words).spell(token) == (near if near and read(token) == read(near) else None)
    assert canonical.SpellingTrie([("нос", 1), ("нож", 9)], 1).spell("ноk") == "нож"  # of equal weight the more frequent


ALIKE = "AАΑᎪꓮaаɑα ​­éefﬁiіoоοⲟο0٠۰’ʼn≠≠⼈人Ⅳv́"


@settings(max_examples=400, deadline=None)
@given(st.text(ALIKE, max_size=14), st.text(ALIKE, max_size=14), st.lists(st.text("AАaаoоnfi人vé", min_size=1, max_size=3), max_size=6))
def test_forms_are_equal_if_and_only_if_texts_read_alike(a, b, words):
    trie = canonical.SpellingTrie([(w, i) for i, w in enumerate(words) if canonical.clean_word(w)])
    ca, cb = canonical.canonical_text(a, trie), canonical.canonical_text(b, trie)
    assert read(ca) == read(a) and (ca == cb) == (read(a) == read(b))


def test_alike_rows(spark):
    rows = [(1, "abc", "x"), (2, "аbc", "x"), (3, "abc", "y"), (4, None, "x"), (5, "", "x"), (6, "​", "x"), (7, " ", "x"), (8, " ", "x"), (9, "abd", "x"), (10, "ａbc", "x"), (11, "z" * 300_000, "x"), (12, "z" * 299_999 + "ｚ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    got = sorted(tuple(r) for r in canonical.read_alike(df).collect())
    assert got == [(1, 2), (1, 10), (2, 3), (2, 10), (3, 10), (11, 12)]
    assert canonical.read_alike(df.limit(0)).count() == 0
    forms = {r["doc_id"]: r["canonical"] for r in canonical.canonical_column(df).collect()}
    assert forms[4] is None and forms[5] == "" and forms[2] == "abc" and len(forms[12]) == 300_000


def test_many_copies_of_one_text_are_no_pairs(spark):
    rows = [(i, "same text") for i in range(3000)] + [(5000, "sаme text")]
    got = canonical.read_alike(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 3000 and all(r["doc_b"] == 5000 for r in got)


def test_spelling_does_not_depend_on_the_number_of_words(spark, monkeypatch):
    """More words than a list of 20,000 would hold, each twice, and CJK runs; then words that occur once. Entries that are
    too many for one trie give the same forms by a join."""
    many = ["ж" + "".join(chr(0x431 + int(d)) for d in f"{i:05d}") for i in range(20_001)]
    runs = ["".join(chr(0x4E00 + int(d)) for d in f"{i:05d}") for i in range(2000)]
    texts = [" ".join(many), " ".join(many + runs + runs), "сенокос, ворон Νίκη սոխ СТО côté МОСТ ёж Үр " + "сор" * 30, "вopoн cенo", "cop cop сор", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    words = canonical.spellings(df)
    got = {r["doc_id"]: r["canonical"] for r in canonical.canonical_column(df, words=words).collect()}
    assert [got[i] for i in range(3)] == texts[:3] and got[3] == "ворон сено" and got[4] == "cop cop cop"
    entries = {r["word"] for r in words.collect()}
    assert {"СТО", "МОСТ", "Үр", "сор" * 30, "ворон", "cop"} <= entries and len(entries) < 20
    monkeypatch.setattr(canonical, "ENTRIES", 2)
    assert {r["doc_id"]: r["canonical"] for r in canonical.canonical_column(df, words=words).collect()} == got


def test_classes_of_alike_rows(spark):
    rows = [(i, "same text") for i in range(5, 300)] + [(5000, "sаme text"), (5001, "ѕаme text"), (1, "alone"), (2, "alone"), (3, None), (4, "")]
    got = {r[0]: tuple(r)[1:] for r in canonical.alike_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: (5, 2) for i in range(5, 300)}, 5000: (5, 296), 5001: (5, 296)}


# tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.load_ranks("byte_bpe_50k"))


def test_every_entry_is_found_and_no_stranger(encoder):
    t = encoder.table
    n = len(t.own)
    assert n > 50_000 and int(t.bits.sum()) == n and sorted(t.place.tolist()) == list(range(n))  # minimal: dense numbers
    words = [t.own[i] for i in np.argsort(t.place)]
    assert t.find(words).tolist() == list(range(n))
    assert (t.find([w + b"\x00q" for w in words[:5000]]) == -1).all()
    assert tokens.PerfectHash([]).find([b"a"]).tolist() == [-1] and tokens.PerfectHash([b"a"]).find([b"a", b"b", b""]).tolist() == [0, -1, -1]
    with pytest.raises(ValueError, match="equal"):
        tokens.PerfectHash([b"a", b"a"])


def test_tasks_need_no_vocabulary_file(spark, encoder, monkeypatch):
    """What is sent to the tasks is the encoder itself, as plain data."""
    import pickle

    copy = pickle.loads(pickle.dumps(encoder))
    assert len(pickle.dumps(encoder)) < 10_000_000
    monkeypatch.setattr(tokens, "load_ranks", None)
    ids, many = copy.encode_all(["an example", None, "", "zqxj", "an example"])
    assert many.tolist() == [2, 0, 0, len(encoder.encode("zqxj")), 2] and ids[:2].tolist() == ids[-2:].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_encoding_like_the_reference_library(encoder, text):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    ids = encoder.encode(text)
    assert ids == own.encode_ordinary(text)
    assert own.decode(ids) == text


def test_encoding_of_a_table(spark, encoder):
    rows = [(1, None, 0), (2, "", 0), (3, "<|endoftext|>", 0), (3, "<|endoftext|>", 0), (4, "ab " * 100_000, 0), (5, "x" * 50_000, 0)]
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()]
    by = dict(got)
    assert len(got) == 6 and by[1] == by[2] == [] and by[3] == encoder.encode("<|endoftext|>") and 50256 not in by[3]
    assert b"".join({v: k for k, v in encoder.ranks.items()}[i] for i in by[5]) == b"x" * 50_000 and len(by[4]) >= 100_000


# leaks


def words(rng, n, vocabulary=12):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("block,part", [(2_000_000, 1_000_000), (40, 30)])
def test_leaks_against_brute_force(spark, monkeypatch, block, part):
    """Few words, so that they repeat a lot; also with the items in blocks and the index in small parts."""
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", block)
    monkeypatch.setattr(leaks, "PART_TOKENS", part)
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.randint(0, 25)))) for i in range(20)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(60):
        w = words(rng, rng.randint(0, 60))
        if d % 3 == 0:
            src = rng.choice(items[:20])[1].split()
            n = rng.choice([8, 9, 10, 11, 25])
            w[5:5] = [x.upper() if rng.random() < 0.3 else x for x in src[2 : 2 + n]]
        docs.append((d, rng.choice([" ", ", ", "\n-- "]).join(w), "x"))
    docs += [(100, None, "x"), (101, "", "x"), docs[0]]
    want = {(d, i) for d, t, _ in docs for i, u in items if any(leaks.words_of(t or "")[k : k + 10] == leaks.words_of(u or "")[j : j + 10] for k in range(len(leaks.words_of(t or "")) - 9) for j in range(len(leaks.words_of(u or "")) - 9))}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaks.find_leaks(df, it).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert leaks.find_leaks(df, it.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), it).count() == 0


def test_words():
    assert leaks.words_of("Ｔhe  ВОДА's​ 3½ x_y café") == leaks.words_of("the вода S 3½ X y CAFÉ")
    assert leaks.words_of("") == [] and leaks.words_of("--- !") == []


def test_one_index_answers_any_number_of_searches(spark, monkeypatch):
    """Once it is written, no text is read or cut into words again, and it holds every word of the corpus."""
    from spotloom.session import durable

    d = spark.createDataFrame([(1, "one two three four"), (2, "four Five ＳＩＸ"), (2, "four five six"), (3, None), (None, "five six")], "doc_id bigint, text string")
    index = durable(leaks.positional_index(d))
    rows = index.collect()
    assert sorted(x for r in rows for x in r["docs"]) == [1, 2, 2]
    assert {t for r in rows for t in r["terms"]} == {"one", "two", "three", "four", "five", "six"} and sum(len(r["places"]) for r in rows) == 10
    monkeypatch.setattr(leaks, "positional_index", None)
    for phrase, want in (("two three", [1]), ("Five six", [2]), ("three four five", [1, 2]), ("four six", []), ("four", [])):
        it = spark.createDataFrame([(7, phrase)], "item_id bigint, text string")
        assert sorted(r.doc_id for r in leaks.find_phrases(index, it, 2).collect()) == want
    terms = pa.array(["four", "none", "six"])
    assert leaks.term_counts(index, terms).tolist() == [3, 0, 2]
    assert "documents" not in leaks.find_phrases(index, it)._jdf.queryExecution().toString()


def near_by_force(docs, items, share=0.8, stretch=1.5, least=5):
    out = set()
    for i, u in items:
        own = leaks.words_of(u or "")
        need, span = -(-len(set(own)) * share // 1), -(-len(own) * stretch // 1)
        if len(set(own)) < least:
            continue
        for d, t in docs:
            w = leaks.words_of(t or "")
            if any(len(set(w[k : k + int(span)]) & set(own)) >= need for k in range(len(w))):
                out.add((d, i))
    return out


@pytest.mark.parametrize("part", [1_000_000, 40])
def test_proximity_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(leaks, "PART_TOKENS", part)
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, rng.randint(0, 12), 60))) for i in range(15)] + [(90, None), (91, "a b c d")]
    docs = []
    for d in range(80):
        w = words(rng, rng.randint(0, 60), 60)
        if d % 2 == 0:
            src = rng.choice(items[:15])[1].split()
            rng.shuffle(src)
            w[5:5] = src[rng.randint(0, 2) :]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, "")]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leaks.find_proximity(df, it).collect()]
    want = near_by_force(docs, items)
    assert set(got) == want and len(got) == len(want) and len(want) > 10
    assert leaks.find_proximity(df.limit(0), it).count() == 0 and leaks.find_proximity(df, it.limit(0)).count() == 0
