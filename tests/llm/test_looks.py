import random
import unicodedata

from pathtide.llm import looks
from pathtide.llm.looks import look_alike_pairs, look_classes, one_form, plain, rewritten, token_scripts

SCHEMA = "doc_id long, text string, form string, r1 int, tokens string"
TEXTS = [
    "Reads that begin at 5 on chromosome 13 were counted in batch K-22663.",
    "Проверьте участок с начала 2116 на хромосоме 3, прежде чем повторять расчёт FAK4.",
    "Ελέγξτε το διάστημα από το 4860 στο χρωμόσωμα 15 πριν επαναλάβετε το BEP1.",
    "Un área de 458 m² quedó vacía; final à 12 °C, café Ω 10⁶ µl.",
    "C", "", "   ", "o", "Ё о й ï",
]


def disguise(text, r):
    """Another string of the same look."""
    out = []
    for c in unicodedata.normalize("NFD", text) if r.random() < 0.5 else text:
        family = looks._CLASS_OF.get(c)
        if family and r.random() < 0.4:
            c = r.choice([x for x in family if x != "-"])
        elif 33 <= ord(c) < 127 and r.random() < 0.2:
            c = chr(ord(c) + 0xFEE0)
        elif c == " " and r.random() < 0.4:
            c = r.choice("      　")
        out.append(c + (r.choice("​­‍﻿⁠") if r.random() < 0.1 else ""))
    return "".join(out).replace("fi", "ﬁ" if r.random() < 0.5 else "fi").replace("Ω", r.choice("ΩΩ"))


def test_equal_looks_get_equal_forms(spark):
    r = random.Random(3)
    rows, truth = [], {}
    for k, t in enumerate(TEXTS * 12):
        text = t if k < len(TEXTS) else disguise(t, r)
        rows.append((k, text, "x", None, None))
        truth[k] = k % len(TEXTS)
    rows += [(500, None, "x", 1, None), (None, "x", "x", 1, None)]
    forms = {x.id: x.form for x in one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert set(forms) == set(truth)
    by = {}
    for k, f in forms.items():
        by.setdefault(f, set()).add(truth[k])
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len(TEXTS)
    found = look_alike_pairs(one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")).collect()
    got = {(x.id_a, x.id_b) for x in found}
    text = {k: t for k, t, *_ in rows}
    assert len(found) == len(got) and got == {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b] and text[a] != text[b]}
    assert {x.rule for x in found} == {"characters", "vocabulary", "fold"}
    classes = {x.id: (x.class_id, x.n_links) for x in look_classes(one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")).collect()}
    assert classes == {k: (truth[k], sum(k in p for p in got)) for k in truth}


def test_differences_to_see_stay(spark):
    pairs = [("m²", "m2"), ("café", "cafe"), ("Reads", "reads"), ("a,b", "a b"), ("a b", "a  b"), ("a-b", "ab"), ("ё", "е"), ("1", "l"), ("α", "a"), ("и", "u"), ("10⁶", "106"), ("…", ".."), ("№", "No")]
    rows = [(i, t, None, None, None) for i, t in enumerate(x for p in pairs for x in p)]
    assert look_alike_pairs(one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")).count() == 0


def test_vocabulary_repair_and_edges(spark):
    rows = [(1, "the second summit", "", 0, ""), (2, "ѕecοnd", "", 0, ""), (3, "sеcret", "", 0, ""), (4, "x" * 100_000 + "​", "", 0, ""), (4, "x" * 100_000, "", 0, "")]
    got = {(x.id, x.repaired) for x in one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").collect()}
    assert (2, "second") in got  # a word of the corpus
    assert (3, "sеcret") in got  # not one: repaired text keeps it, its form folds it
    empty = spark.createDataFrame([], SCHEMA)
    assert look_alike_pairs(one_form(empty, "doc_id", "text")).count() == 0
    # the same id twice is no pair with itself
    assert look_alike_pairs(one_form(spark.createDataFrame(rows[3:], SCHEMA), "doc_id", "text")).count() == 0


def test_vocabulary_decides_near_look_alikes(spark):
    rows = [(1, "a red key", "", 0, ""), (2, "a red кey", "", 0, ""), (3, "τhe κеу", "", 0, ""), (4, "the кeq", "", 0, ""), (5, "the keq 2", "", 0, ""), (6, "the key", "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = lambda **kw: {(x.id_a, x.id_b, x.rule) for x in look_alike_pairs(one_form(df, "doc_id", "text", **kw)).collect()}
    # κеу of Greek and Cyrillic letters is key, as the corpus has that word; so is τhe.
    assert pairs() == {(1, 2, "vocabulary"), (3, 6, "vocabulary")}
    assert pairs(vocabulary=False) == set()


def test_signs_and_fonts(spark):
    pairs = [("a-b", "a‐b"), ("a-b c", "a‑b c"), ("1:2", "1∶2"), ("1/2", "1⁄2"), ("Read", "𝐑𝐞𝐚𝐝"), ("ГЛПФ", "ΓΛΠΦ"), ("a,b", "a‚b"), ("gene", "ɡene")]
    rows = [(2 * i + j, t, None, None, None) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {(x.id_a, x.id_b) for x in look_alike_pairs(one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(pairs))}
    apart = [("a-b", "a–b"), ("a-b ", "a−b "), ("it's", "it’s"), ("1", "𝟏"), ("i", "ı")]
    rows = [(i, t, None, None, None) for i, t in enumerate(x for p in apart for x in p)]
    assert look_alike_pairs(one_form(spark.createDataFrame(rows, SCHEMA), "doc_id", "text")).count() == 0


def test_token_rules():
    assert token_scripts("ѕecοnd") == (True, "L") and rewritten("ѕecοnd", "L") == "second"
    assert rewritten("Oκολo", "G") == "Οκολο" and token_scripts("ВОР")[1] is None
    assert plain("é") == "é" and plain("ﬁ​ｘ") == "fix"
