"""Language, toxicity, SimHash, templates and I-Match against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import xxhash

from emberlog.llm import components, imatch, language, simhash, templates, toxicity

INSULTS = ["blithering", "numbskull", "dimwitted"]


def test_language(documents, nothing):
    got = {r["doc_id"]: r for r in language.languages(documents).collect()}
    for row in documents.where("doc_id < 80").collect():
        assert got[row["doc_id"]]["lang_pred"] == row["lang"]
        assert 0 <= got[row["doc_id"]]["score"] <= 1
    assert all(got[n]["lang_pred"] == "und" and got[n]["score"] == 0 for n in range(100, 104))
    assert got[None]["held_out"] is False
    assert language.languages(nothing).collect() == []


def test_language_without_labels(documents):
    bare = documents.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in language.languages(bare).collect()} == {"und"}


def test_language_filter_answers_for_all_languages():
    rows = [("a", 11), ("a", 12), ("b", 12)]
    model = language.build_filter(rows, ["a", "b"])
    held = lambda h: model.masks[language.probes(np.array([h], np.uint64))[0]][0]
    assert held(11) & 1 and held(12) & 3 == 3
    assert (model.false_positive < 1e-9).all()


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Some words, Größe and 中文字 " * 9
    whole = np.concatenate(language.grams(text))
    monkeypatch.setattr(language, "BLOCK_CHARS", 5)
    assert (np.concatenate(language.grams(text)) == whole).all()


def test_toxicity(spark, nothing):
    rng = random.Random(5)
    rows, labels = [], []
    for n in range(400):
        words = [rng.choice("river stone walking mountain bread quiet lamp".split()) + rng.choice("abcde") for _ in range(30)]
        if n % 3 == 0:
            words[rng.randrange(30)] = rng.choice(INSULTS)
        rows.append((n, " ".join(words), "clash", 5))
        labels.append((n, n % 3 == 0 and 1 or 0))
    rows += [(900, None, None, None), (901, "", None, None), (None, "river", None, None), (902, (INSULTS[0] + " " + "bread " * 40) * 500, None, None)]
    labels += [(900, None), (None, 1), (5, 7), (900, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    right = sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held)
    assert len(held) > 40 and right / len(held) > 0.95
    assert got[902]["predicted"] == 1
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.toxicity(docs.limit(0), marks).collect() == []
    nobody = toxicity.toxicity(docs, marks.limit(0)).collect()
    assert {r["predicted"] for r in nobody} == {0}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or (
        [b" ".join(words)] if words else []
    )
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes, bits=3):
    root = list(range(len(codes)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(n) for n in range(len(codes))]


def test_simhash_documents(documents, nothing):
    rows = sorted(
        (r["doc_id"], brute_fingerprint(r["text"]))
        for r in documents.where("doc_id IS NOT NULL").collect()
    )
    groups = brute_groups([c for _, c in rows])
    wanted = sorted((i, f"{c:016x}", rows[g][0]) for (i, c), g in zip(rows, groups))
    got = simhash.near_duplicates(documents.where("doc_id IS NOT NULL")).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == wanted
    alone = simhash.near_duplicates(documents.where("doc_id IS NULL")).collect()
    assert len(alone) == 1 and alone[0]["component_id"] is None
    assert simhash.near_duplicates(nothing).collect() == []


def near_codes(rng, count):
    """Codes in dense balls, chains and far apart."""
    codes = [rng.getrandbits(64) for _ in range(count // 4)]
    for _ in range(3 * count // 4):
        code = rng.choice(codes)
        for _ in range(rng.randint(0, 5)):
            code ^= 1 << rng.randrange(64)
        codes.append(code)
    return sorted(set(codes))


def test_variant_links_connect_like_all_pairs(spark):
    rng = random.Random(11)
    codes = near_codes(rng, 600)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    for block in (1000, 7):
        links = simhash.link_fingerprints(frame, block=block)
        roots = {r["node"]: r["root"] for r in components.components(links).collect()}
        groups = brute_groups(codes)
        named = [roots.get(s, s) for s in signed]
        pairs = set(zip(groups, named))
        assert len(pairs) == len(set(groups)) == len(set(named))


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 500)], "a long, b long")
    got = components.components(chain).collect()
    assert sorted(r["node"] for r in got) == list(range(1, 201))
    assert {r["root"] for r in got} == {0}
    assert components.components(chain.limit(0)).collect() == []


def test_one_document_of_each_group_stays(documents):
    kept = simhash.distinct_documents(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = simhash.near_duplicates(documents).collect()
    assert len(ids) == len({(r["component_id"]) for r in groups})
    assert 3 in ids and 107 not in ids and 108 not in ids and ids.count(105) == 1


def test_templates(spark, nothing):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "ba ce di fo gu ha".split() for b in "lo mi ne ru sa ti".split()]
    text = lambda n: " ".join(rng.choices(words, k=n))
    question = (
        "A train leaves with 40 wagons at 60 km from Berlin and Anna counts 40 wagons, "
        "so how many wagons does Anna see after 3 hours near Berlin"
    )
    changed = (
        "A train leaves with 55 wagons at 80 km from Madrid and Peter counts 55 wagons, "
        "so how many wagons does Peter see after 7 hours near Madrid"
    )
    mixed = changed.replace("counts 55", "counts 56").replace("near Madrid", "near Oslo")
    plain = text(30)
    items = [(1, question), (2, plain), (3, None), (4, ""), (None, text(20)), (5, "short one")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, f"{text(50)}. {question}. {text(40)}", 1),
            (2, f"{text(50)}. {changed}. {text(40)}", 1),
            (3, f"{text(50)}. {mixed}. {text(40)}", 1),
            (4, f"{text(10)} {plain.upper()} {text(10)}", 1),
            (5, f"{text(300)}", 1),
            (6, None, 1),
            (7, "", 1),
            (8, "Short one!", 1),
            (9, f"short one {text(20)}", 1),
            (10, f"{text(9)} {plain} {text(9)} {plain}", 1),
            (10, f"{text(9)} {plain} {text(9)} {plain}", 1),
            (None, plain, 1),
        ],
        "doc_id long, text string, coverage int",
    )
    got = [(r["doc_id"], r["contaminated"], r["item_id"]) for r in templates.contamination(docs, benchmark).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, True, 1), (2, True, 1), (3, False, None), (4, True, 2), (5, False, None), (6, False, None), (7, False, None),
         (8, True, 5), (9, False, None), (10, True, 2), (10, True, 2), (None, True, 2)],
        key=str,
    )
    kept = templates.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 9]
    assert templates.clean(docs, benchmark.limit(0)).count() == docs.count()
    assert templates.contamination(nothing, benchmark).collect() == []


def test_imatch(documents, nothing, monkeypatch):
    monkeypatch.setattr(imatch, "IDF_BAND", (0.0, 99.0))
    got = imatch.fingerprint_report(documents).collect()
    rows = sorted(
        documents.select("doc_id", "text").collect(),
        key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)),
    )
    texts = [r["text"] or "" for r in rows]
    edited = []
    for n, text in enumerate(texts):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + texts[(n + 1) % len(texts)][:half])
    wanted = [
        (r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest())
        for r, t, e in zip(rows, texts, edited)
    ]
    assert sorted(map(str, wanted)) == sorted(str((r[0], r[1], r[2])) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[107]["fingerprint"] == by_id[108]["fingerprint"] == by_id[3]["fingerprint"]
    assert by_id[108]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len(by_id[5]["fingerprint"]) == 4 * imatch.SCALES * imatch.DRAWS
    assert imatch.fingerprint_report(nothing).collect() == []


def test_imatch_of_half_and_other_texts(spark):
    rng = random.Random(9)
    vocabulary = [f"w{n}x" for n in range(3000)]
    rows = [(n, " ".join(rng.sample(vocabulary, 150))) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.fingerprint_report(docs).collect()
    edited = np.mean([r["near_edited"] for r in got])
    following = np.mean([r["near_next"] for r in got])
    assert edited > following + 0.1
