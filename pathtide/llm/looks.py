"""Bringing texts that look the same to one form.

Width, composition, invisible characters, spaces, fonts and ligatures are settled character by
character. Look-alike letters are settled token by token: the dominant script of a mixed token is
taken from its letters that have no look-alike, and the token is rewritten when the result is a
word of the corpus - there also letters that are only nearly alike. What the vocabulary can't
settle (codes, tokens made of look-alikes only, words that occur nowhere else) is folded by a fixed
rule, so that texts of equal look are equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.llm.classes import members_of_links
from pathtide.operators.joins import attach
from pathtide.session import cut, sized_broadcast

# Letters of equal look in Latin, Cyrillic and Greek; "-" where a script has none.
LOOK_ALIKES = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y У Υ
Z - Ζ
a а -
c с -
e е -
i і -
j ј -
o о ο
p р ρ
s ѕ -
v - ν
x х -
y у -
- Г Γ
- Л Λ
- П Π
- Ф Φ
"""
# Letters few writers use that look like the one they are listed with; nothing is rewritten to them.
RARE_LOOK_ALIKES = "CϹ cϲ JͿ jϳ QԚ qԛ WԜ wԝ dԁ hһ vѵ YҮ IӀ lӏ gɡ GԌ hհ oօ uս nո qզ OՕ SՏ LԼ UՍ AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ"
# Letters that are nearly alike, the Latin one first; only a word of the corpus decides that one is meant.
NEAR_LOOK_ALIKES = "aαɑ iιı kкκ mм nηп oσ rг tтτ uυ wωш yγ xχ bвЬ hн"
# Signs of equal look, the plain one first. Other dashes and curved quotes are seen as such.
SIGNS = "-‐‑ :∶։׃꞉ /⁄∕ ,‚ !ǃ |∣ǀ ~∼ .․ ·⋅∙‧ ’ʼ Δ∆ Σ∑ Π∏"
_SCRIPTS = "LCG"
_CLASSES = [tuple(line.split()) for line in LOOK_ALIKES.split("\n") if line]
_CLASS_OF = {c: k for k in _CLASSES for c in k if c != "-"}
_SHARED = set(_CLASS_OF)
for _latin, _rare in RARE_LOOK_ALIKES.split():
    _SHARED.add(_rare)
    _CLASS_OF.setdefault(_latin, (_latin, "-", "-"))
    _CLASS_OF[_rare] = _CLASS_OF[_latin]
_NEAR = {c: k[0] for k in NEAR_LOOK_ALIKES.split() for c in k[1:]}
_FOLD = {ord(c): next(x for x in k if x != "-") for c, k in _CLASS_OF.items()}
_TOKEN = re.compile(r"(?:[^\W_]|[\u0300-\u036f])+")
#: The same for Spark's regular expressions.
TOKEN = "[\\p{L}\\p{N}\u0300-\u036f]+"
# Characters without a look of their own that are not of the format category, and format characters that have one.
_FILLERS = "\u034f\u115f\u1160\u3164\uffa0\u180b\u180c\u180d\u180f"
_SEEN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2\U000110bd\U000110cd"
_LIGATURES = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0xFB00, 0xFB06), (0xFB13, 0xFB17))
# Compatibility letters of the same look as the letter they stand for.
_SAME_LOOK = "\u00b5"
# Letters of two scripts side by side, digits and accents between them left aside; the micro sign's letter is at home in Latin units.
_L, _G, _C = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff", "\u0370-\u03bb\u03bd-\u03ff\u1f00-\u1fff", "\u0400-\u052f"
_MIXED = re.compile("|".join(f"[{x}][0-9\u0300-\u036f]*[{y}]" for x, y in ((_L, _G + _C), (_G, _L + _C), (_C, _L + _G))))


@lru_cache(maxsize=1)
def character_map() -> dict[int, str]:
    """What each odd character is replaced with before composition: nothing, a space, or plain letters and signs."""
    out: dict[int, str] = {}
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        kind, shape = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Zs":
            out[cp] = " "
        elif (kind == "Cf" and c not in _SEEN_FORMAT) or c in _FILLERS or 0xFE00 <= cp <= 0xFE0F or kind == "Cc":
            out[cp] = ""
        elif shape.startswith(("<wide>", "<narrow>")) or c in _SAME_LOOK or any(a <= cp <= b for a, b in _LIGATURES) or (shape.startswith("<font>") and kind[0] == "L"):
            out[cp] = unicodedata.normalize("NFKC", c)
    out |= {cp: "" for cp in range(0xE0000, 0xE01F0)}
    out |= {cp: "" for cp in range(0x20) if chr(cp) not in "\t\n\r"}
    out |= {0x7F: "", 0x09: " "}
    for plain_one, *others in SIGNS.split():
        out |= {ord(c): plain_one for c in others}
    return out


def plain(text: str) -> str:
    """``text`` with width, composition, invisible characters, spaces and ligatures in one form."""
    if text.isascii() and text.isprintable():
        return text
    text = text.translate(character_map())
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _script(c: str) -> str | None:
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else None
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if c.isalpha() else None
    if 0x400 <= o < 0x530:
        return "C" if c.isalpha() else None
    return "L" if 0x1E00 <= o < 0x1F00 else None


@lru_cache(maxsize=200_000)
def token_scripts(token: str) -> tuple[bool, str | None]:
    """(whether letters of several scripts occur, dominant script of its letters that no other script has)."""
    found, own = set(), Counter()
    for c in unicodedata.normalize("NFD", token):
        s = _script(c)
        if s:
            found.add(s)
            if c not in _SHARED:
                own[s] += 1
    return len(found) > 1, min(own, key=lambda s: (-own[s], _SCRIPTS.index(s))) if own else None


def folded(text: str) -> str:
    """``text`` with every look-alike letter as the first of its class."""
    return text if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_FOLD))


@lru_cache(maxsize=200_000)
def rewritten(token: str, script: str) -> str:
    """``token`` with every look-alike letter in ``script``, or in the first script that has one."""
    k = _SCRIPTS.index(script)
    out = []
    for c in unicodedata.normalize("NFD", token):
        family = _CLASS_OF.get(c)
        out.append(c if family is None else family[k] if family[k] != "-" else next(x for x in family if x != "-"))
    return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=200_000)
def spellings(token: str) -> tuple[str, ...]:
    """What a mixed-script token may be meant to be, the likelier first: its look-alikes in its dominant script, then the nearly alike too.

    The dominant script is that of the letters without look-alikes; a token of look-alikes only may
    be of any script it has letters of. Only spellings in one script are given.
    """
    several, lead = token_scripts(token)
    if not several:
        return ()
    leads = [lead] if lead else sorted({s for s in map(_script, unicodedata.normalize("NFD", token)) if s}, key=_SCRIPTS.index)
    out = [rewritten(token, s) for s in leads]
    near = "".join(_NEAR.get(c, c) for c in unicodedata.normalize("NFD", token))
    out.append(rewritten(unicodedata.normalize("NFC", near), "L"))
    return tuple(w for w in dict.fromkeys(out) if w != token and not token_scripts(w)[0])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The plain text, its mixed tokens that have other spellings, and its folded form where that is another one."""
    for pdf in batches:
        texts = [plain(raw) for raw in pdf["text"]]
        tokens = [[t for t in dict.fromkeys(_TOKEN.findall(x)) if spellings(t)] if _MIXED.search(x) else [] for x in texts]
        forms = [None if (f := folded(x)) == x else f for x in texts]
        yield pd.DataFrame({"id": pdf["id"], "r1": pdf["r1"], "r2": pdf["r2"], "text": texts, "form": pd.Series(forms, dtype=object), "tokens": tokens})


def _wishes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(token, place, word): the spellings of each token in their order."""
    for pdf in batches:
        rows = [(t, k, w) for t in pdf["token"] for k, w in enumerate(spellings(t))]
        yield pd.DataFrame(rows, columns=["token", "place", "word"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Applies the settled rewrites, then folds what is left."""
    for pdf in batches:
        repaired = []
        for text, pairs in zip(pdf["text"], pdf["fixes"], strict=True):
            fixes = {p["token"]: p["word"] for p in pairs}
            repaired.append(_TOKEN.sub(lambda m, fixes=fixes: fixes.get(m[0], m[0]), text))
        yield pd.DataFrame({"id": pdf["id"], "r1": pdf["r1"], "r2": pdf["r2"], "plain": pdf["text"], "repaired": repaired, "form": [folded(x) for x in repaired]})


def _code(column: str) -> list:
    """A 128-bit code of a string."""
    return [F.xxhash64(column), F.xxhash64(F.lit("second"), column, F.length(column))]


def token_fixes(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """The words of the corpus that mixed tokens are meant to be: token, word.

    tokens: token, distinct; texts: text. Of a token's spellings the first that occurs anywhere in
    the texts is taken, of equal rank the most frequent. The vocabulary itself is never gathered:
    only words that some token asks for are counted.
    """
    wished = cut(tokens.mapInPandas(_wishes, "token string, place int, word string"))
    asked = cut(wished.select("word").distinct())
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("word"))
    known = words.join(sized_broadcast(asked, asked.count()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return wished.join(known, "word").groupBy("token").agg(F.min_by("word", F.struct("place", -F.col("n"), "word")).alias("word"))


def one_form(df: DataFrame, id_col: str, text_col: str, vocabulary: bool = True) -> DataFrame:
    """Every text in one form: id, plain, repaired, form, r1, r2.

    plain: characters settled. repaired: also mixed-script tokens rewritten to words of the corpus
    (not with ``vocabulary`` off). form: the same with the remaining look-alikes folded; two texts
    look the same exactly if their forms are equal. r1, r2: a 128-bit code of the text as it was.
    Rows with a null id or text take no part; an empty text is its own form; repeated rows stay; an
    empty table gives no rows. Case, accents, raised digits, punctuation and the number of spaces
    are kept. Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    keys = ["id", "r1", "r2"]
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    own = own.select("id", "text", *[c.alias(n) for c, n in zip(_code("text"), ("r1", "r2"), strict=True)])
    # Printable ASCII is its own form; it only adds to the vocabulary.
    odd = F.rlike("text", F.lit("[^ -~]"))
    easy = own.filter(~odd).select(*keys, *[F.col("text").alias(n) for n in ("plain", "repaired", "form")])
    scanned = cut(own.filter(odd).mapInPandas(_scan, f"id {kind}, r1 long, r2 long, text string, form string, tokens array<string>"))
    if not vocabulary:
        scanned = scanned.withColumn("tokens", F.array().cast("array<string>"))
    marked = scanned.filter(F.size("tokens") > 0)
    texts = own.filter(~odd).select("text").unionByName(scanned.select("text"))
    fixes = cut(token_fixes(marked.select(F.explode("tokens").alias("token")).distinct(), texts))
    each = marked.select(*keys, F.explode("tokens").alias("token"))
    fixed = attach(each, fixes, ["token"], keys).groupBy(*keys).agg(F.collect_set(F.struct("token", "word")).alias("fixes"))
    settled = marked.join(fixed, keys).select(*keys, "text", "fixes").mapInPandas(_settle, f"id {kind}, r1 long, r2 long, plain string, repaired string, form string")
    rest = scanned.join(fixed.select(*keys), keys, "left_anti") if vocabulary else scanned
    rest = rest.select(*keys, F.col("text").alias("plain"), F.col("text").alias("repaired"), F.coalesce("form", "text").alias("form"))
    return easy.unionByName(settled.select(*easy.columns)).unionByName(rest)


def _members(forms: DataFrame) -> DataFrame:
    steps = [c.alias(f"{n}{k}") for name, n in (("plain", "p"), ("repaired", "q"), ("form", "f")) for k, c in enumerate(_code(name), 1)]
    return cut(forms.select("id", "r1", "r2", *steps))


def look_alike_pairs(forms: DataFrame) -> DataFrame:
    """Pairs id_a < id_b of :func:`one_form` rows whose forms are equal and whose texts were not, with the rule that settles them.

    rule: ``characters`` if their plain texts are equal already, ``vocabulary`` if their repaired
    ones are, else ``fold``. Equal texts are classes first, so a boilerplate text that fills a third
    of the table meets only the odd spellings of it, never its own copies, and is met in parts.
    """
    members = _members(forms)
    form, text = ["f1", "f2"], ["r1", "r2"]
    # One row a text; what is made of it depends on it alone.
    classes = members.groupBy(*form, *text).agg(*[F.first(c).alias(c) for c in ("p1", "p2", "q1", "q2")])
    classes = cut(classes.select(*form, F.struct(*text, "p1", "p2", "q1", "q2").alias("t")))
    shared = classes.groupBy(*form).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    both = members_of_links(shared.select(*[F.col(c).alias(f"{s}_{c}") for s in "ab" for c in form]), classes, classes, form, "t")
    same = lambda c: (F.col(f"id_a.{c}1") == F.col(f"id_b.{c}1")) & (F.col(f"id_a.{c}2") == F.col(f"id_b.{c}2"))
    rule = F.when(same("p"), "characters").when(same("q"), "vocabulary").otherwise("fold")
    links = both.filter(F.struct("id_a.r1", "id_a.r2") < F.struct("id_b.r1", "id_b.r2"))
    links = links.select(*[F.col(f"id_{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in text], rule.alias("rule"))
    own = members.select("id", *text)
    got = members_of_links(cut(links), own, own, text, "id").filter(F.col("id_a") != F.col("id_b"))
    # The same pair of ids may come of repeated rows.
    return got.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "rule").groupBy("id_a", "id_b").agg(F.min("rule").alias("rule"))


def look_classes(forms: DataFrame) -> DataFrame:
    """One row per id and text: id, class_id (the least id of equal look) and n_links, the rows of equal look whose text is another string."""
    members = _members(forms).select("id", "r1", "r2", "f1", "f2")
    texts = members.groupBy("f1", "f2", "r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    looks = texts.groupBy("f1", "f2").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"))
    known = texts.join(looks, ["f1", "f2"]).select("r1", "r2", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return attach(members.select("id", "r1", "r2"), known, ["r1", "r2"], ["id"]).select("id", "class_id", "n_links")
