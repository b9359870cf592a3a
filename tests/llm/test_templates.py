"""Copies of benchmark items with single changes, several rows and many parameters."""

from __future__ import annotations

import random
import time

import numpy as np

from emberlog.llm import templates

FILLER = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lo mi ne ru sa ti".split()]


def found(spark, items: list[str], docs: list[tuple[int, str]]) -> dict:
    rng = random.Random(6)
    texts = []
    for n, text in docs:
        before, after = (" ".join(rng.choices(FILLER, k=30)) for _ in range(2))
        texts.append((n, f"{before}. {text}. {after}"))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = templates.matches(rows, benchmark).collect()
    return {(r["key"], r["item_id"]): r for r in got}


def test_one_changed_occurrence_loses_only_its_windows(spark):
    words = [f"{FILLER[n % 36]}q{FILLER[n * 5 % 36]}" for n in range(60)]
    for at in (8, 22, 36, 50):
        words[at] = "Tom"
    item = " ".join(words)
    words[36] = "Tim"
    got = found(spark, [item], [(1, " ".join(words))])
    assert got[1, 0]["run"] >= 30 and got[1, 0]["coverage"] >= 0.9 - 1e-9


def test_different_slots_may_take_one_value(spark):
    item = "the farmer sells 5 of all his red hens and then buys 3 more of the brown hens there"
    copy = item.replace("5", "4").replace("3", "4")
    assert found(spark, [item], [(1, copy)])[1, 0]["coverage"] == 1.0


def test_rows_with_one_id_are_aligned_by_themselves(spark):
    item = "when Tom walks 7 miles along this old river then his friend meets Tom after 7 hours there"
    copies = [item.replace("Tom", a).replace("7", b) for a, b in (("Ann", "8"), ("Eva", "9"))]
    got = found(spark, [item], [(1, copies[0]), (1, copies[1])])
    assert got[1, 0]["coverage"] == 1.0


def test_inconsistent_slots_do_not_count(spark):
    item = "when Tom walks 7 miles then Tom rests and Tom sleeps and Tom eats so where is Tom now"
    names = iter(["Ann", "Eva", "Max", "Kim", "Lea"])
    copy = " ".join(next(names) if w == "Tom" else w for w in item.split())
    assert found(spark, [item], [(1, copy)]) == {}


def test_items_dense_in_parameters(spark):
    item = "so Anna has 5 kg and Bob 7 kg and Eva 9 kg and Max 4 kg and Kim 2 kg of red plums, who has most"
    copy = "so Petra has 6 kg and Jim 8 kg and Una 1 kg and Leo 3 kg and Fay 11 kg of red plums, who has most"
    got = found(spark, [item], [(1, copy), (2, item)])
    assert got[1, 0]["coverage"] == got[2, 0]["coverage"] == 1.0
    assert got[1, 0]["run"] == len(templates.template(item)[0])


def test_wide_windows_hold_enough_plain_words():
    text = "we put 1 2 3 4 5 6 7 8 9 in a box"
    hashes, places, starts, widths, slots = templates.text_windows(text)
    wide = widths > templates.WINDOW
    assert wide.any() and set(places.tolist()) == set(range(len(slots) - 4))
    for at, start, width in zip(places[wide], starts[wide], widths[wide]):
        assert start <= at and at + 5 <= start + width
        assert (slots[start : start + width] == 0).sum() == templates.LEAST_WORDS
    narrow = templates.text_windows(text, 6)
    assert narrow[3].max() <= 6


def test_an_item_of_thousands_of_numbers_is_quick():
    rng = random.Random(3)
    numbers = " ".join(str(rng.randrange(10**6)) for _ in range(2000))
    text = f"tell me the sum of {numbers} and then the mean of them all"
    began = time.perf_counter()
    hashes, places, *_ = templates.text_windows(text)
    assert time.perf_counter() - began < 0.5
    assert set(places.tolist()) == set(range(len(text.split()) - 4)) and len(hashes) < 8000


def test_spans_are_told_apart_by_their_codes():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, 300).astype(np.int64)
    spans = [(a, a + n) for n in (1, 2, 7, 40) for a in range(0, 300 - n)]
    starts, ends = (np.array(x) for x in zip(*spans))
    found = templates.spans(codes, starts, ends)
    seen: dict = {}
    for (a, b), value in zip(spans, found.tolist()):
        content = tuple(codes[a:b].tolist())
        assert seen.setdefault(content, value) == value
    assert len(set(seen.values())) == len(seen)


def test_a_number_dense_item_is_found_with_other_numbers(spark):
    rng = random.Random(6)

    def question(seed: int, swap: bool) -> str:
        draw = random.Random(seed)
        values = [str(draw.randrange(10, 999)) for _ in range(60)]
        if swap:
            values = [str(int(v) + 1000) for v in values]
        return "tell me the sum of " + " ".join(values) + " and then the mean of them all"

    items = spark.createDataFrame([(1, question(1, False))], "item_id long, text string")
    other = " ".join(rng.choice(["river", "stone", "12", "rain"]) for _ in range(80))
    docs = spark.createDataFrame(
        [(1, "Here: " + question(1, False)), (2, "Well, " + question(1, True) + " " + other),
         (3, question(2, False)[:35] + " river " + other), (4, other)],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.contaminated for r in templates.contamination(docs, items).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_words_of_ascii_texts_are_those_of_any_text():
    rng = random.Random(3)
    signs = ["ab", "Cd", "7", "19", "'", "_", ".", ",", ":", "/", "!", "?", "\n", "%", "$", " ", "-"]
    for _ in range(3_000):
        text = "".join(rng.choices(signs, k=rng.randrange(30)))
        assert templates.ASCII_TOKEN.findall(text) == templates.TOKEN.findall(text)


def test_plain_windows_are_made_only_where_a_placeholder_stands():
    text = "the red box holds 12 apples and then five more boxes came to Anna by train today"
    hashes, places, _, widths, slots = templates.text_windows(text)
    plain = templates.windows(templates.template(text)[2])
    held = {int(p): int(h) for h, p, w in zip(hashes, places, widths) if w == 0}
    with_slots = [n for n in range(len(plain)) if slots[n : n + templates.WINDOW].any()]
    assert sorted(held) == with_slots and 0 < len(with_slots) < len(plain)
    assert all(held[n] == plain[n] for n in with_slots)
