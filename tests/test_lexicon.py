"""The phrase automaton and the passes over an item's fields, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomwright.functions.automaton import Phrases, left_to_right
from loomwright.operators import phrases
from loomwright.plans import lexicon

LETTERS = "ab"


def plain_spans(text, surfaces, fused):
    out = []
    for s in surfaces:
        wanted = s.replace(" ", "") if fused else s
        for start in range(len(text) - len(wanted) + 1):
            end = start + len(wanted)
            if text[start:end] == wanted and (fused or (start == 0 or text[start - 1] == " ") and (end == len(text) or text[end] == " ")):
                out.append((start, len(wanted), s))
    return sorted(out)


def plain_sweep(spans):
    out, upto, last = [], 0, None
    for start, size, s in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
        if start >= upto or (start, size) == last:
            out.append((start, size, s))
            last, upto = (start, size), start + size
    return out


def text_of(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_automaton():
    rng = random.Random(4)
    for _ in range(300):
        surfaces = sorted({text_of(rng, rng.randint(1, 3)) for _ in range(rng.randint(0, 6))})
        found = Phrases(surfaces)
        text, fused = text_of(rng, rng.randint(1, 9)), rng.random() < 0.5
        text = text.replace(" ", "") if fused else text
        named = lambda spans: [(a, b, surfaces[k]) for a, b, k in spans]
        assert sorted(named(found.spans(text, fused))) == plain_spans(text, surfaces, fused)
        assert named(left_to_right(found.spans(text, fused))) == plain_sweep(plain_spans(text, surfaces, fused))


@pytest.mark.parametrize("most", [200_000, 3])
def test_find(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_SURFACES", most)
    rng = random.Random(9)
    surfaces = sorted({text_of(rng, rng.randint(1, 3)) for _ in range(12)})
    rows = [(k % 40, text_of(rng, rng.randint(1, 30)), False) for k in range(60)] + [(100 + k, text_of(rng, 6).replace(" ", ""), True) for k in range(20)]
    rows += [(7, "a b a b", False)] * 3 + [(200, None, False), (201, "", True), (None, "ab a", False), (300, "a " * 5000 + "b", False)]
    texts = spark.createDataFrame(rows, "id long, text string, fused boolean").repartition(3).select("*", F.lit(1).alias("at_"), F.lit("x").alias("n_"))
    wanted = spark.createDataFrame([(s,) for s in [*surfaces, surfaces[0], "", None]], "surface string")
    for longest in (False, True):
        pick = plain_sweep if longest else lambda x: x
        want = sorted(
            (i is None, i or 0, 0 if fused else text.count(" ", 0, a), 1 if fused else s.count(" ") + 1, a, b, s) for i, text, fused in rows if text for a, b, s in pick(plain_spans(text, surfaces, fused))
        )
        found = phrases.find(texts, wanted, longest).collect()
        assert sorted((r["id"] is None, r["id"] or 0, r["at"], r["n"], r["start"], r["size"], r["surface"]) for r in found) == want
    assert phrases.find(texts, wanted.limit(0)).count() == 0


def plain_evidence(items, dictionary, everyday):
    meanings = {}
    for surface, item, name_only, popularity in dictionary:
        if surface:
            old = meanings.setdefault(surface, {}).get(item, (True, 0.0))
            meanings[surface][item] = (old[0] and name_only, max(old[1], popularity))
    known = {w for s in meanings for w in s.split()}
    everywhere = [s for s, m in meanings.items() if not all(x[0] for x in m.values())]
    out = set()
    for i, tokens, symbol, description in items:
        tokens = tokens or []
        one = [t[:-1] if len(t) >= 4 and t.endswith("s") and not t.endswith("ss") and t not in known and t[:-1] in known else t for t in tokens]
        name, fused = " ".join(tokens), "".join(tokens)
        passes = [("name", name, False), ("name", fused, True), ("name", " ".join(one) if one != tokens else "", False)]
        passes += [("symbol", (symbol or "").lower() if len(symbol or "") >= 3 else "", False), ("description", description or "", False)]
        for field, text, letters in passes:
            surfaces = list(meanings) if field == "name" else everywhere
            surfaces = [s for s in surfaces if not letters or len(s.replace(" ", "")) >= 4]
            for _, _, s in plain_sweep(plain_spans(text, surfaces, letters)):
                tail = " " not in s and s not in tokens and any(t.endswith(s) and 1 <= len(t) - len(s) <= 2 for t in tokens)
                if field == "name" and tail:
                    continue
                for item, (name_only, popularity) in meanings[s].items():
                    if field == "name" or not name_only:
                        weight = (0.5 + 0.35 * popularity) * (0.8 if field == "symbol" else 1.0)
                        out.add((i, field, s, item, round(weight, 3), s in everyday and popularity < 0.8))
    return out


def test_evidence(spark):
    items = [
        (1, ["calm", "lake", "ferns"], "CALM", "a calm lake in the calm"), (2, ["calmlake"], "XI", None), (3, ["xalder", "pines"], "PINE", "alder pine pine"), (4, ["crane", "lift", "yard"], None, "crane lift crane"),
        (5, None, None, None), (6, [], "", ""), (7, ["glass", "bus"], "GLAS", "ferns and calm sea"), (8, ["such", "a", "quiet", "rain"], "QUIET", "quiet rain"), (8, ["such", "a", "quiet", "rain"], "QUIET", "quiet rain"),
    ]
    dictionary = [
        ("calm lake", 1, False, 0.91), ("calm", 2, False, 0.31), ("fern", 3, False, 0.47), ("alder", 4, True, 0.63), ("alder pine", 4, False, 0.63), ("pine", 5, True, 0.11), ("crane", 6, False, 0.27), ("crane lift", 7, False, 0.83),
        ("quiet rain", 8, False, 0.57), ("such a quiet rain", 9, False, 0.57), ("quiet", 10, True, 0.33), ("calm", 11, True, 0.93), ("glas", 12, False, 0.21), ("", 13, False, 0.5), ("fern", 3, True, 0.49), ("lift yard", 14, False, 0.13),
    ]
    dictionary = [(*d[:3], d[3] + 0.0013) for d in dictionary]  # no weight in the middle between two thousandths
    everyday = {"calm", "crane", "pine"}
    found = lexicon.evidence(
        spark.createDataFrame(items, "id long, tokens array<string>, symbol string, description string").select("*", F.lit("x").alias("text")),
        spark.createDataFrame(dictionary, "surface string, item_id long, name_only boolean, popularity double"),
        spark.createDataFrame([(w,) for w in everyday] * 2, "word string"),
    ).collect()
    got = {tuple(r[c] for c in ("id", "field", "surface", "item_id", "weight", "generic")) for r in found}
    assert len(found) == len(got)
    assert got == plain_evidence(items, dictionary, everyday)
    assert (2, "name", "calm lake", 1) in {r[:4] for r in got} and (1, "name", "fern", 3) in {r[:4] for r in got} and (3, "name", "alder", 4) not in {r[:4] for r in got}


def test_evidence_of_random_items(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abs") for _ in range(rng.randint(1, 5)))
    dictionary = [(" ".join(word() for _ in range(rng.randint(1, 3))), k % 30, rng.random() < 0.3, 0.1373 + 0.001 * (k % 30)) for k in range(60)]
    items = [(k, [word() for _ in range(rng.randint(0, 4))], word().upper(), " ".join(word() for _ in range(rng.randint(0, 40)))) for k in range(120)]
    found = lexicon.evidence(
        spark.createDataFrame(items, "id long, tokens array<string>, symbol string, description string"),
        spark.createDataFrame(dictionary, "surface string, item_id long, name_only boolean, popularity double"),
        spark.createDataFrame([("a",), ("ab",)], "word string"),
    )
    assert {tuple(r) for r in found.collect()} == plain_evidence(items, dictionary, {"a", "ab"})


def test_everyday_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(k, "common word" if k % 2 else f"rare{'abcdefghij'[k % 10]}x") for k in range(100)] + [(200, None)], "doc_id long, text string")
    assert {r[0] for r in lexicon.everyday_words(docs).collect()} == {"common", "word", *{re.sub("[0-9]", "", f"rare{x}x") for x in "acegi"}}
