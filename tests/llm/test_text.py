import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sylva.llm import bpe, leaks, personal, similar_text
from sylva.llm.probminhash import signatures
from sylva.llm.queries import vocabulary

WORDS = "lantern harbor quartz meadow copper ribbon saddle velvet timber canyon orchid puzzle magnet walnut thunder bishop".split()


# Tokens

TEXTS = [
    "", None, "a", "  two  blanks ", "aaaa" * 500, " " * 3000, "it's we'LL <|endoftext|> x", "١٢ ½ Ⅷ 一二 ünï 𝒳 👩‍👩‍👧", "a\r\n\r\n\tb \x1c\x1d x",
    "=" * 999 + "\n", "x" * 70_000, "word " * 20_000, "　wide space​",
]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab \n'9é—") for _ in range(rng.randrange(60))) for _ in range(300)] + ["a"]
    rows = [(k, t, 7, "clash") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, lang string")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df, path).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == reference.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_corpus(df.limit(0), path).collect() == []


def test_word_memory_does_not_change_ids(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    one, two = bpe.Encoder(path), bpe.Encoder(path)
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for text in ["alpha beta gamma delta", "beta epsilon", "zeta alpha eta theta", ""] * 2:
        small = two.encode([text])[0].tolist()
        monkeypatch.setattr(bpe, "MEMORY", 10**6)
        assert one.encode([text])[0].tolist() == small
        monkeypatch.setattr(bpe, "MEMORY", 3)


# Leaks


def brute_leaks(docs, items, n):
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    runs = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(len(w) - n + 1):
            runs[tuple(w[k : k + n])].add(i)
    found = set()
    for d, t in docs:
        w = split(t)
        for k in range(len(w) - n + 1):
            found |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return found


@pytest.mark.parametrize("piece", [2_000_000, 300])
def test_leaks_equal_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(leaks, "SLICE", piece)
    rng = random.Random(4)
    say = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(3, 30)))) for k in range(30)] + [(90, None), (91, ""), (92, "a b c d e f g h i j k"), (93, "a b c d e f g h i j k")]
    docs = [(-1, None), (-2, ""), (-3, "A_b-C.d e\nf\\g/h  i(j)"), (-4, "xa b c d e f g h i j")]
    for k in range(120):
        parts = say(rng.randrange(5, 200))
        source = rng.choice(items[:30])[1].split()
        at, n = rng.randrange(len(source)), rng.randrange(8, 14)
        parts[3:3] = source[at : at + n]
        docs.append((k, rng.choice([" ", "\n", "_", ", "]).join(parts).upper() if k % 3 else "é ".join(parts)))
    index = leaks.ItemIndex([(i, t) for i, t in items if t], 10, 0)
    found = leaks._pass(spark.createDataFrame(docs, "doc_id long, text string"), spark.sparkContext.broadcast(index)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items, 10)
    assert len(found) == len({(r.doc_id, r.item_id) for r in found})


def test_leaks_with_edits_and_empty_inputs(spark):
    passage = " ".join(WORDS[k % 16] + str(k % 3) for k in range(24))
    edited = passage.replace("harbor1", "harbour1").replace("copper1", "coper1", 1)
    docs = spark.createDataFrame([(1, "x y z " + edited + " tail"), (2, "nothing here at all"), (3, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, item_text string")
    assert {r.doc_id for r in leaks.leaks(docs, items, words=20, edits=3).collect()} == {1, 3}
    assert {r.doc_id for r in leaks.leaks(docs, items, words=20).collect()} == {3}
    assert leaks.leaks(docs, items.limit(0)).collect() == [] and leaks.leaks(docs.limit(0), items).collect() == []


def near(passage, text, edits):
    """Whether some part of ``text`` is at most so many edits from ``passage``, character by character."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row) <= edits


def test_consecutive_items_with_edits():
    rng = random.Random(7)
    items = [(k, " ".join(f"{rng.choice(WORDS)}{rng.randrange(900)}" for _ in range(26))) for k in range(6)]
    index = leaks.ItemIndex(items, 20, 3)
    for lead in range(1, 9):
        pasted = [t if k % 2 else t[:60] + "#" + t[61:] for k, t in items]
        data = leaks.characters("y" * lead + " " + " ".join(pasted))
        assert {item for _, item, _ in index.found(data)} == set(range(6))


@pytest.mark.parametrize("hits", [4_000_000, 40])
def test_edits_of_characters_equal_brute_force(monkeypatch, hits):
    monkeypatch.setattr(leaks, "HITS", hits)
    rng = random.Random(21)
    letters = {"latin": "forêtmèrénüßcaz", "greek": "αβγδεζηθικλμνξ", "han": "天地玄黃宇宙洪荒日月盈昃", "emoji mix": "aéя漢b"}
    items, docs = [], []
    for k, name in enumerate(list(letters) * 2):
        word = lambda: "".join(rng.choice(letters[name]) for _ in range(rng.randrange(3, 9)))  # noqa: E731, B023
        items.append((k, " ".join(word() for _ in range(23))))
    for k in range(40):
        text = list(items[k % 8][1])
        for _ in range(k // 8 + rng.randrange(3)):
            spot = rng.randrange(len(text))
            text[spot : spot + rng.randrange(2)] = rng.choice(["", "x", "é", "漢"])
        docs.append("vor " + "".join(text) + " nach")
    index = leaks.ItemIndex(items, 20, 3)
    missed = wrong = right = 0
    for text in docs:
        tidy = leaks.plain(text).decode()
        want = {
            i for i, t in items
            if (w := leaks.plain(t).decode().split()) and any(near(" ".join(w[k : k + 20]), tidy, 3) for k in range(len(w) - 19))
        }
        got = {item for _, item, _ in index.found(np.concatenate([[10], leaks.characters(text), [10]]).astype(np.uint32))}
        missed, wrong, right = missed + len(want - got), wrong + len(got - want), right + len(want & got)
    assert right > 20 and not wrong and missed == 0


def test_dropped_accents_count_once(spark):
    passage = " ".join(f"{w}{k}" for k, w in enumerate("la forêt où ma mère a tôt rangé le blé gelé près de la rivière été comme hiver très bien".split()))
    docs = spark.createDataFrame([(1, passage.replace("forêt", "foret").replace("mère", "mere").replace("tôt", "tot"))], "doc_id long, text string")
    items = spark.createDataFrame([(5, passage)], "item_id long, item_text string")
    assert leaks.leaks(docs, items, words=20, edits=3).count() == 1
    assert leaks.leaks(docs, items, words=20, edits=2).count() == 0


def test_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 100)
    items = [(k, " ".join(random.Random(k).choices(WORDS, k=14))) for k in range(12)]
    docs = [(k, "lead " + t + " tail") for k, t in items]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items, 10)


# Near duplicates


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 60).astype(np.uint64)
    b = np.concatenate([a[:40], rng.integers(0, 2**63, 20).astype(np.uint64)])
    owner = np.repeat([0, 1], 60)
    sign = signatures(owner, np.concatenate([a, b]), 2, 4000)
    assert abs((sign[0] == sign[1]).mean() - 0.5) < 0.04
    shuffled = rng.permutation(120)
    again = signatures(owner[shuffled], np.concatenate([a, b])[shuffled], 2, 4000)
    assert (again == sign).all()
    weight = np.where(np.isin(np.concatenate([a, b]), a[:40]), 0.1, 1.0).astype("f4")
    light = signatures(owner, np.concatenate([a, b]), 2, 4000, weight)
    assert abs((light[0] == light[1]).mean() - 4 / 44) < 0.03


def brute_pairs(rows):
    sets = {}
    for k, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if k is not None and len(w) >= 12:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}


def test_pairs_and_groups_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(14, 60))]
        rows.append((10 * k, " ".join(base)))
        for j in range(rng.randrange(3)):
            words = list(base)
            for _ in range(1 + j):
                words[rng.randrange(len(words))] = "edit"
            rows.append((10 * k + j + 1, " ".join(words).title()))
    rows += [(1000 + k, rows[0][1]) for k in range(40)]  # one text holds a third
    rows += [(2000, None), (2001, ""), (2002, "few words only"), rows[5], rows[6]]
    df = spark.createDataFrame(rows, "key long, text string")
    want = brute_pairs(rows)
    got = [(r.key_a, r.key_b) for r in similar_text.similar_pairs(df).collect()]
    assert set(got) <= want and len(got) == len(set(got)) and len(got) >= 0.995 * len(want)
    groups = {r.key: r for r in similar_text.similar_groups(df).collect()}
    assert len(groups) == len({k for k, t in rows if len((t or "").split()) >= 12})
    for a, b in got:
        assert groups[a].group_key == groups[b].group_key
    assert groups[1005].class_key == 0
    assert similar_text.similar_pairs(df.limit(0)).collect() == []
    assert similar_text.similar_groups(df.limit(0)).collect() == []


def test_hot_group_of_edited_copies_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar_text, "BLOCK", 16)  # hot bands go out in blocks
    rng = random.Random(12)
    base = [rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(100)]
    rows = []
    for k in range(150):  # a third of all rows, no two of them equal
        words = list(base)
        words[rng.randrange(100)] = f"edit{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(30))) for k in range(300)]
    want = brute_pairs(rows)
    assert len(want) == 150 * 149 // 2
    got = [(r.key_a, r.key_b) for r in similar_text.similar_pairs(spark.createDataFrame(rows, "key long, text string")).collect()]
    assert set(got) == want and len(got) == len(want)


# Personal information


@pytest.mark.parametrize(
    "text, want",
    [
        ("Send the net to Ann.Lee+x@Mail.Example.org before", {("email", "annleexmailexampleorg")}),
        ("write to us: j-lee [at] corp [dot] ferrow [dot] test now", {("email", "jleeatcorpdotferrowdottest")}),
        ("<ann dot lee at quill dot test>", {("email", "anndotleeatquilldottest")}),
        ("Ring +44 (0)20 7946 0722 if", {("phone", "4402079460722")}),
        ("Call 1.305.555.0180 or (212) 555-0100, 07700 900 692", {("phone", "13055550180"), ("phone", "2125550100"), ("phone", "07700900692")}),
        ("Order PO-5077-27-2936 covers rows 825 558 8438.", set()),
        ("x_1\t666-11-1246\tSSN\t+14155550152", {("id_number", "666111246"), ("phone", "14155550152")}),
        ("passport: Q2805979; NI number=ZZ 26 51 37 B", {("id_number", "q2805979"), ("id_number", "zz265137b")}),
        ("moved from Flat 11, 40 Hazel Court to the clause (Mina Istra)", {("address", "flat1140hazelcourt"), ("name", "minaistra")}),
        ("stands at 237, avenue du Vieux Moulin, Colbrook.", {("address", "237avenueduvieuxmoulin")}),
        ("Calle del Olmo 240 | Winterbornestraße 22", {("address", "calledelolmo240"), ("address", "winterbornestraße22")}),
        ("Deliver it to Elif K. O'Tarrish, 211A Mill Rd. today", {("name", "elifkotarrish"), ("address", "211amillrd")}),
        ("Graded by José Ulver and Noor Hollin-Brask Here", {("name", "joséulver"), ("name", "noorhollinbrask")}),
        ("As Prof. Goran Fenni pointed out", {("name", "goranfenni")}),
        ("@cargo.route('/x') matrix @ replica.T crane@4 px; Needs 26 drive bays and a 8 lane bus", set()),
        ("", set()),
        ("a" * 80 + "@" + "b" * 300 + ".example,", {("email", "a" * 80 + "b" * 300 + "example")}),
        ("x the dot product; MAIL J.DOE [AT] CORP [DOT] TEST or jo {at} x.test, li[ at ]y.test", {
            ("email", "jdoeatcorpdottest"), ("email", "joatxtest"), ("email", "liatytest")}),
        ("Lou Dot Kay At Quill Dot Test", {("email", "loudotkayatquilldottest")}),
        ("n" * 120 + " at " + "m" * 200 + " dot test", {("email", "n" * 120 + "at" + "m" * 200 + "dottest")}),
        ("SSN: 000-12-3456, SSN: 123-00-4567, SSN: 123-45-0000", {("id_number", "000123456")}),
        ("Contact Anna Svensson at the desk. My name is Ola B. Nord.", {("name", "annasvensson"), ("name", "olabnord")}),
    ],
)
def test_values(text, want):
    assert {(k, personal.bare(text[a:b])) for a, b, k in personal.find(text)} == want


def test_permutations_are_one_to_one_within_the_format():
    p = personal.Pseudonyms(b"k")
    assert sorted(p.permute(x, 1000, "t") for x in range(1000)) == list(range(1000))
    assert p.of("666-11-1246", "id_number") != "666-11-1246" and re.fullmatch(r"\d{3}-\d{2}-\d{4}", p.of("666-11-1246", "id_number"))
    date = p.of("19770905-743F", "id_number")
    assert re.fullmatch(r"(19|20)\d\d(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])-\d{3}F", date)
    assert personal.Pseudonyms(b"other").of("19770905-743F", "id_number") != date


def test_forms_stay_apart_and_valid():
    p = personal.Pseudonyms(b"k")
    values = [f"{y}{m:02d}{d:02d}-123X" for y in (1990, 2000) for m in range(0, 14) for d in range(0, 34)]
    images = [p.digits(v, "id_number") for v in values]
    assert len(set(images)) == len(values)
    for v, image in zip(values, images):
        assert (personal._day(v[:8], "%Y%m%d") is None) == (personal._day(image[:8], "%Y%m%d") is None)
    assert personal._day(p.digits("19900131-1234", "id_number")[:8], "%Y%m%d")
    for x in (12345678, 99999999, 1):
        right = f"{x:08d}" + "TRWAGMYFPDXBNJZSQVHLCKE"[x % 23]
        image = p.digits(right, "id_number")
        assert image != right and "TRWAGMYFPDXBNJZSQVHLCKE"[int(image[:8]) % 23] == image[8]
    assert personal.possible(p.digits("001-01-0001", "id_number"))


def test_one_telephone_number_is_one_pseudonym():
    p = personal.Pseudonyms(b"k")
    forms = ["+44 20 7946 0722", "+44 (0)20 7946 0722", "020 7946 0722"]
    tails = {"".join(c for c in p.of(x, "phone") if c.isdigit())[-7:] for x in forms}
    assert len(tails) == 1 and tails != {"9460722"}
    assert len({p.of(f"555-{k:04d}", "phone") for k in range(2000)}) == 2000


def test_redaction_keeps_the_rest(spark):
    text = "Call 212-555-0100 if\nCall 212-555-0100 again, a@b.example" + " pad" * 50_000
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, pii_type string")
    got = {r.doc_id: r.text for r in personal.redacted(df, "k").collect()}
    assert got[2] is None and got[3] == ""
    m = re.fullmatch(r"Call \[PHONE:(\d{3}-\d{3}-\d{4})\] if\nCall \[PHONE:(\1)\] again, \[EMAIL:\d{20}\](?: pad){50000}", got[1])
    assert m and m[1] != "212-555-0100"
    rows = personal.personal_values(df, "k").collect()
    assert sorted((r.doc_id, r.pii_type, r.pii_value) for r in rows) == [(1, "email", "abexample"), (1, "phone", "2125550100")]
    assert personal.personal_values(df.limit(0), "k").collect() == []
