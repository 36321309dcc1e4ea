"""One consistent form for text that reads alike.

A text is cut into tokens and what stands between them. Each token, as it stands, walks a trie of the corpus' own spellings
by a weighted edit automaton: a sign passes an edge of the same shape at no cost, whatever its script, width or way of
composition, an ignorable passes none at no cost, and any other edit costs one, which is more than is allowed. The states
alive are the nodes that the token may have reached, several where spellings of different scripts share a shape. A token
that ends at an entry takes the entry's spelling. Only what matches nothing, and what stands between tokens, is put into
its form by the table of shapes: invisible characters go, blanks of any kind are a space, composed and decomposed accents
are one, and a letter, digit or mark becomes the sign that stands for its shape; a word with a letter that only one other
script has is put into that script where all its letters have a form there.

Two texts have one form if and only if they read alike, whatever the entries: these choose spellings. Accents, letter case,
and raised or circled signs are kept apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotloom.session import durable

#: Fixed values, after the public tables of confusable characters: letters of one shape, each string of a script against
#: the letters and digits below it that stand for the shapes.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜѴӀһасеіјорѕухԁԛԝѵӏҽ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXYGQWVIhaceijopsyxdqwvle"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορϳϲ"
GREEK_LATIN = "ABEZHIKMNOPTYXayivopjc"
ARMENIAN = "օսոհցզյՕՍՏԼ"
ARMENIAN_LATIN = "ounhgqjOUSL"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"
CHEROKEE_LATIN = "DRTiAJEWMHYGZ4bRWSVSLCPKdGB"
LISU = "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_LATIN = "BPdDTGKJCZFMNLSRVHWXYAEIOU"
COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ"
COPTIC_LATIN = "BHIKMNOoPpCcTYX"
LATIN = "ɑɡ"
LATIN_LATIN = "ag"
ARABIC = "۰۱۲۳۷۸۹ی"
ARABIC_SHAPE = "٠١٢٣٧٨٩ى"
SCRIPTS = {"CYRILLIC": (CYRILLIC, CYRILLIC_LATIN), "GREEK": (GREEK, GREEK_LATIN), "ARMENIAN": (ARMENIAN, ARMENIAN_LATIN), "CHEROKEE": (CHEROKEE, CHEROKEE_LATIN), "LISU": (LISU, LISU_LATIN), "COPTIC": (COPTIC, COPTIC_LATIN), "LATIN": (LATIN, LATIN_LATIN), "ARABIC": (ARABIC, ARABIC_SHAPE)}
#: Marks of one shape, and the mark that stands for them.
MARKS = {"‐": "-", "‑": "-", "﹣": "-", "ʼ": "’", "⁄": "/", "∕": "/", "∶": ":", "։": ":", "꞉": ":", "ꓽ": ":", "ǀ": "|", "∣": "|", "‧": "·", "⋅": "·", "․": ".", "ꓸ": ".", "‚": ",", "ꓹ": ",", "ǃ": "!", "ʹ": "′"}
#: Characters that read as nothing though they are letters or marks by category.
IGNORABLE = "͏ᅟᅠ឴឵ㅤﾠ"

#: Entries that are sent to every task, at most; beyond, each row is joined with the entries its own tokens may reach.
ENTRIES = 500_000


def fold_signs(text: str) -> str:
    """Like ``read_signs`` with letter case ignored too: a letter also reads as its look-alike of the other case does."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_folded))


class _Folded(dict):
    """What each sign of a decomposed text reads as in one case, found when first asked for."""

    def __missing__(self, o: int) -> str:
        self[o] = to = unicodedata.normalize("NFD", unicodedata.normalize("NFD", read_signs(chr(o)).casefold()).translate(_fold_table()))
        return to


_folded = _Folded()


@lru_cache(1)
def _fold_table() -> dict[int, str]:
    """Letters that have no look-alike themselves but whose capitals have, against that in small."""
    table = shape_table()
    pairs = [(a.casefold(), b.casefold()) for own, latin in SCRIPTS.values() for a, b in zip(own, latin, strict=True)]
    return {ord(a): b for a, b in pairs if len(a) == 1 and a != b and (ord(a) not in table or a in CHEROKEE)}


def _ignorable(c: str) -> bool:
    o = ord(c)
    return c in IGNORABLE or unicodedata.category(c) == "Cf" or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or (unicodedata.category(c) == "Cc" and not c.isspace())


def _shape(c: str) -> str | None:
    """What a decomposed sign reads as, or None if it reads as itself."""
    if _ignorable(c):
        return ""
    if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp") or c == "⠀":
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind in ("<wide>", "<narrow>", "<compat>") and rest:
        to = "".join(chr(int(x, 16)) for x in rest.split())
        # of the looser kind only ligatures, numerals made of letters and radicals have the shape of their letters; a single
        # letter there, such as the long s, is another shape of it
        if kind != "<compat>" or all(x.isalpha() for x in to) and (len(to) > 1 or unicodedata.category(c) in ("So", "Nl")):
            return "".join(unicodedata.normalize("NFD", x) for x in to)
    return None


#: The table of shapes and the patterns that cut texts: built once where a job is put together, and sent to its tasks.
_known: dict[str, object] = {}


def reading_state() -> dict[str, object]:
    """All that ``use_state`` gives to another process, so that it need not be built there."""
    shape_table(), _cutters(), word_patterns()
    return dict(_known)


def use_state(state: dict[str, object]) -> None:
    if not _known:
        _known.update(state)


def shape_table() -> dict[int, str]:
    """Code point to what it reads as, built from the character database and the look-alike letters."""
    if "table" not in _known:
        places = (range(0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x20000), range(0xE0000, 0xE1000))
        table = {o: s for r in places for o in r if (s := _shape(chr(o))) is not None}
        for own, latin in SCRIPTS.values():
            table |= {ord(a): b for a, b in zip(own, latin, strict=True)}
        table |= {ord(a): b for a, b in MARKS.items()}
        # a look-alike may itself come from another form, as a full-width mark does
        _known["table"] = {o: "".join(table.get(ord(c), c) if ord(c) != o else c for c in s) for o, s in table.items()}
    return _known["table"]


def read_signs(text: str) -> str:
    """The text sign by sign, each as the one that stands for its shape. Idempotent; equal for texts that read alike."""
    if text.isascii() and text.isprintable():
        return text
    table = shape_table()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table)).translate(table))


#: Letters that stand for others' shapes, back to those of each script; of several the first.
BACK = {n: {ord(b): a for a, b in reversed([*zip(own, latin, strict=True)])} for n, (own, latin) in SCRIPTS.items() if n not in ("LATIN", "ARABIC")}


@lru_cache(65_536)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def script_spelling(read: str) -> str:
    """A word, as it reads, in the one other script that its letters show; as it reads if they show none or several, or
    if a letter has no form in that script."""
    if read.isascii():
        return read
    parts = unicodedata.normalize("NFD", read)
    scripts = {_script(c) for c in parts if c.isalpha()} - {"LATIN"}
    back = BACK.get(next(iter(scripts))) if len(scripts) == 1 else None
    if back is None or any(c.isalpha() and _script(c) == "LATIN" and ord(c) not in back for c in parts):
        return read
    return unicodedata.normalize("NFC", parts.translate(back))


@lru_cache(65_536)
def sign_shapes(c: str) -> str:
    """The signs that one sign of a decomposed text reads as: none for an ignorable, several for a ligature."""
    return unicodedata.normalize("NFD", read_signs(c))


class SpellingTrie:
    """Spellings in a trie over their own signs, walked by a weighted edit automaton.

    A token's signs are taken as they are. A sign passes an edge that has its shape, and an ignorable passes none, at a
    weight of 0; to replace, leave out or put in a sign weighs 1. The automaton's states are the nodes reached with their
    least weights; those over ``limit`` die. With the limit of 0 that texts are canonized with, a walk follows the few
    nodes whose spellings read like the token so far. Entries that read alike are one: the more frequent, then the smaller.
    """

    def __init__(self, words: list[tuple[str, int]], limit: float = 0.0):
        self.limit = limit
        # per node: its edges by the shape they have, as (sign, node), and its entry
        self.edges: list[dict[str, list[tuple[str, int]]]] = [{}]
        self.entry: list[tuple[int, str] | None] = [None]
        taken: set[str] = set()
        for word, n in sorted(words, key=lambda x: (-x[1], x[0])):
            if (shape := read_signs(word)) in taken:
                continue
            taken.add(shape)
            at = 0
            for sign in unicodedata.normalize("NFD", word):
                for one in sign_shapes(sign):
                    at = self._child(at, one, sign)
            self.entry[at] = (-n, word)
        #: plain tokens that an entry may spell in another way
        self.plain = {t for t in taken if t.isascii()}

    def _child(self, at: int, shape: str, sign: str) -> int:
        own = self.edges[at].setdefault(shape, [])
        for s, to in own:
            if s == sign:
                return to
        self.edges.append({})
        self.entry.append(None)
        own.append((sign, len(self.entry) - 1))
        return own[-1][1]

    def spell(self, token: str) -> str | None:
        """The entry that the token reaches with the least weight within the limit, or None."""
        if self.limit:
            return self._spell_near(token)
        live, edges = [0], self.edges
        for c in unicodedata.normalize("NFD", token):
            for shape in sign_shapes(c):
                live = [to for at in live for _, to in edges[at].get(shape, ())]
                if not live:
                    return None
        found = [e for at in live if (e := self.entry[at])]
        return min(found)[1] if found else None

    def _spell_near(self, token: str) -> str | None:
        def left_out(live: dict[int, float]) -> dict[int, float]:
            """Edges passed without a sign of the token."""
            todo = list(live)
            while todo:
                at = todo.pop()
                w = live[at] + 1
                if w <= self.limit:
                    for own in self.edges[at].values():
                        for _, to in own:
                            if live.get(to, w + 1) > w:
                                live[to] = w
                                todo.append(to)
            return live

        live = left_out({0: 0.0})
        for c in unicodedata.normalize("NFD", token):
            for shape in sign_shapes(c):
                after: dict[int, float] = {}
                for at, w in live.items():
                    steps = [(to, w + (s != shape)) for s, own in self.edges[at].items() for _, to in own]
                    for to, v in [*steps, (at, w + 1)]:
                        if v <= self.limit and after.get(to, v + 1) > v:
                            after[to] = v
                live = left_out(after)
        found = [(w, *e) for at, w in live.items() if (e := self.entry[at])]
        return min(found)[2] if found else None


def clean_word(word: str) -> bool:
    """Whether a word can be an entry: letters of one script, composed, and nothing read as another form."""
    if unicodedata.normalize("NFC", word) != word:
        return False
    scripts = set()
    for c in word:
        if c.isalpha():
            scripts.add(unicodedata.name(c, "?").split()[0])
    return len(scripts) == 1 and not scripts & {"FULLWIDTH", "KANGXI", "CJK"} and unicodedata.normalize("NFKC", word) == word


def _ranges(codes: set[int]) -> str:
    """The inside of a pattern's class of characters."""
    out, first, last = [], None, None
    for o in [*sorted(codes), -1]:
        if last is not None and o == last + 1:
            last = o
            continue
        if last is not None:
            out.append(f"\\U{first:08x}" + (f"-\\U{last:08x}" if last > first else ""))
        first = last = o
    return "".join(out)


def _runs(start: set[int], more: set[int], group: bool) -> tuple[str, str]:
    """Patterns of a sign of ``start`` and all that follow of either: for texts of the basic plane, where a class is a
    table and not a search, and for all."""
    low = lambda x: {o for o in x if o < 0x10000}
    one = lambda a, b: f"[{_ranges(a)}][{_ranges(b)}]*"
    both = one(low(start), low(start | more)), one(start, start | more)
    return tuple(f"({x})" for x in both) if group else both


def _categories() -> dict[str, set[int]]:
    out: dict[str, set[int]] = {"L": set(), "N": set(), "M": set()}
    for o in range(0x110000):
        if (k := unicodedata.category(chr(o))[0]) in out:
            out[k].add(o)
    return out


def word_patterns() -> tuple[str, str]:
    """Runs of letters and digits, with the marks on them that have no composed form."""
    if "words" not in _known:
        c = _categories()
        _known["words"] = _runs(c["L"] | c["N"], c["M"], False)
    return _known["words"]


def _cutters() -> dict[str, object]:
    """Patterns of tokens, and the signs that read as a mark and a letter.

    What a sign reads as decides whether it is part of a token, so texts that read alike are cut alike. A token starts with
    a letter or digit; accents and ignorables go on with it.
    """
    if "cutters" not in _known:
        c = _categories()
        word = lambda s: all(x.isalnum() or unicodedata.category(x)[0] == "M" for x in s)
        shapes = {o: r for o in shape_table() if (r := sign_shapes(chr(o))) != chr(o)}
        ignorable = {o for o, r in shapes.items() if not r}
        start = (c["L"] | c["N"]) - {o for o, r in shapes.items() if not r or not word(r)}
        start |= {o for o, r in shapes.items() if r and not chr(o).isalnum() and word(r) and r[0].isalnum()}
        mixed = {o: r for o, r in shapes.items() if not word(r) and any(x.isalnum() for x in r)}
        marks = _ranges(c["M"] - ignorable)
        between = f"(?<=[{marks}])[{_ranges(ignorable)}]+(?=[{marks}])"
        _known["cutters"] = {"tokens": _runs(start, c["M"] | ignorable, True), "mixed": mixed, "has_mixed": f"[{_ranges(set(mixed))}]", "between": between}
    return _known["cutters"]


@lru_cache(1)
def _tokenizer():
    """(cut, mixed, between, has_mixed): ``cut`` gives what stands between tokens at even places, tokens at odd ones."""
    k = _cutters()
    low, full = (re.compile(p).split for p in k["tokens"])
    return lambda t: (full if _HIGH(t) else low)(t), k["mixed"], re.compile(k["between"]), re.compile(k["has_mixed"])


_HIGH = re.compile("[\U00010000-\U0010ffff]").search
_PLAIN = re.compile(r"[A-Za-z0-9]+")


def canonical_text(text: str, trie: SpellingTrie, cache: dict | None = None) -> str:
    """The one form of a text: each token as the trie spells it, all else by the table."""
    if text.isascii() and text.isprintable() and (not trie.plain or trie.plain.isdisjoint(_PLAIN.findall(text))):
        return text
    cache = {} if cache is None else cache
    cut, mixed, between, has_mixed = _tokenizer()
    text = unicodedata.normalize("NFD", text)
    if has_mixed.search(text):
        text = text.translate(mixed)
    out = cut(text)
    for i, piece in enumerate(out):
        if (to := cache.get(piece)) is None:
            to = None
            if i % 2:
                to = trie.spell(unicodedata.normalize("NFD", between.sub("", piece)))
                if to is None:
                    to = script_spelling(read_signs(piece))
            else:
                to = read_signs(piece)
            if len(piece) < 200:
                if len(cache) > 200_000:
                    cache.clear()
                cache[piece] = to
        out[i] = to
    return unicodedata.normalize("NFC", "".join(out))


def spellings(texts: DataFrame, column: str = "text") -> DataFrame:
    """(read, word, n): the entries of the corpus, counted over all its texts.

    Of the words that read alike the most frequent clean one is the entry, then the smallest; it is left out where all of
    them are in plain ASCII, or where there is only one and the table spells it as it is. One row per entry, on the cluster.
    """
    w = texts.select(F.explode(F.expr(rf"regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Cf}}]*', 0)")).alias("w"))

    state = texts.sparkSession.sparkContext.broadcast(reading_state())

    @F.pandas_udf("read string, clean boolean, own boolean")
    def reads(words: pd.Series) -> pd.DataFrame:
        use_state(state.value)
        got = [(r := read_signs(w), clean_word(w), script_spelling(r) == w) for w in words]
        return pd.DataFrame(got, columns=["read", "clean", "own"])

    counted = w.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    plain = F.expr(r"w rlike '^[\\x00-\\x7f]*$'")
    odd = counted.where(~plain).select("w", "n", reads("w").alias("r")).select("r.read", "w", "n", "r.clean", "r.own", F.lit(True).alias("odd"))
    even = counted.where(plain).select(F.col("w").alias("read"), "w", "n", F.lit(True).alias("clean"), F.lit(True).alias("own"), F.lit(False).alias("odd"))
    best = F.min(F.when(F.col("clean"), F.struct((-F.col("n")).alias("n"), "w", "own"))).alias("b")
    # plain words only matter to those that read like them: theirs are few, and each is one row here
    classes = odd.unionByName(even).groupBy("read").agg(best, F.bool_or("odd").alias("odd"), F.count(F.lit(1)).alias("ways"))
    return classes.where("odd and b is not null and (ways > 1 or not b.own)").select("read", F.col("b.w").alias("word"), (-F.col("b.n")).alias("n"))


def canonical_column(texts: DataFrame, text: str = "text", out: str = "canonical", words: DataFrame | None = None) -> DataFrame:
    """``texts`` with the canonical form of column ``text`` in ``out``; null stays null, an empty text empty.

    ``words``: entries of the trie (see ``spellings``). Up to ENTRIES they are sent to all tasks in one trie; of more, each
    row gets those that its own tokens may reach, by a join, and walks a trie of them. Whole texts are read, however long.
    Other columns pass through.
    """
    cols = [c for c in texts.columns if c != out]
    if words is None:
        held = []
    else:
        words = durable(words)
        if words.count() > ENTRIES:
            return _canonical_by_row(texts, text, out, words)
        held = [(r[0], r[1]) for r in words.select("word", "n").collect()]  # at most ENTRIES
    entries = texts.sparkSession.sparkContext.broadcast((held, reading_state()))

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use_state(entries.value[1])
        trie = SpellingTrie(entries.value[0])
        cache: dict = {}
        for s in batches:
            yield s.map(lambda t: None if t is None else canonical_text(t, trie, cache))

    return texts.select(*cols, F.pandas_udf(work, T.StringType())(F.col(text)).alias(out))


def _canonical_by_row(texts: DataFrame, text: str, out: str, words: DataFrame) -> DataFrame:
    cols = [c for c in texts.columns if c != out]
    state = texts.sparkSession.sparkContext.broadcast(reading_state())

    @F.pandas_udf("array<string>")
    def readings(ts: pd.Series) -> pd.Series:
        use_state(state.value)
        cut, mixed, _, _ = _tokenizer()
        return ts.map(lambda t: [] if t is None else sorted({read_signs(w) for w in cut(unicodedata.normalize("NFD", t).translate(mixed))[1::2]}))

    @F.pandas_udf("string")
    def spell(ts: pd.Series, own: pd.Series) -> pd.Series:
        use_state(state.value)
        tries = [SpellingTrie([(w["word"], w["n"]) for w in o] if o is not None else []) for o in own]
        return pd.Series([None if t is None else canonical_text(t, trie) for t, trie in zip(ts, tries, strict=True)], dtype=object)

    rows = durable(texts.select(*cols).withColumn("_row", F.monotonically_increasing_id()))
    reach = rows.select("_row", F.explode(readings(F.col(text))).alias("read")).join(words, "read")
    own = reach.groupBy("_row").agg(F.collect_list(F.struct("word", "n")).alias("_own"))  # at most the words of one text
    return rows.join(own, "_row", "left").select(*cols, spell(F.col(text), F.col("_own")).alias(out))


def read_alike(texts: DataFrame, key: str = "doc_id", text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(doc_a, doc_b): pairs of rows with visible text that reads the same but differs in code points, smaller key first.

    Rows with equal text are no case, so copies are gathered first: only forms with at least two different texts go on,
    and only different texts are paired, before their rows are joined to them. Null, empty and invisible texts are no
    cases. For one row per document instead of pairs see ``alike_classes``.
    """
    hashed = _hashed_forms(texts, key, text, words)
    variants = hashed.select("form", "t").distinct()
    several = variants.groupBy("form").count().where("count > 1").select("form")
    variants = variants.join(several, "form", "left_semi")
    pairs = variants.select("form", F.col("t").alias("ta")).join(variants.select("form", F.col("t").alias("tb")), "form").where("ta <> tb").drop("form")
    # each unordered pair of texts stands twice, once from either side: rows of the first text are the smaller keys
    own = hashed.join(several, "form", "left_semi")
    a = pairs.join(own.select(F.col("t").alias("ta"), F.col("k").alias("doc_a")), "ta")
    b = a.join(own.select(F.col("t").alias("tb"), F.col("k").alias("doc_b")), "tb")
    return b.where("doc_a < doc_b").select("doc_a", "doc_b")


def _hashed_forms(texts: DataFrame, key: str, text: str, words: DataFrame | None) -> DataFrame:
    rows = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    form = canonical_column(rows, "t", "form", words).where("form is not null and trim(form) <> ''")
    return durable(form.select("k", F.sha2(F.col("form"), 256).alias("form"), F.sha2(F.col("t"), 256).alias("t")))


def alike_classes(texts: DataFrame, key: str = "doc_id", text: str = "text", words: DataFrame | None = None) -> DataFrame:
    """(<key>, first, n_links): of each row that reads like a row of another text, the smallest key that reads so, and the
    number of rows that read like it but differ in code points. Grows with the rows, however many are alike."""
    hashed = _hashed_forms(texts, key, text, words)
    per_text = hashed.groupBy("form", "t").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    per_form = per_text.groupBy("form").agg(F.sum("n").alias("all"), F.min("k").alias("first"), F.count(F.lit(1)).alias("ways")).where("ways > 1")
    own = per_text.select("form", "t", "n").join(per_form, "form").select("form", "t", "first", (F.col("all") - F.col("n")).alias("n_links"))
    return hashed.join(own, ["form", "t"]).select(F.col("k").alias(key), "first", "n_links")
