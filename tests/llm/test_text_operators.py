"""Operators that treat each text by itself: against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import differences
from fixtures import docs, nothing, prose, rows
from tokenizers import Tokenizer

from sparkplume.llm import bpe, language, licences, pii, quality, toxicity
from sparkplume.llm import arrays as A
from sparkplume.llm import decontaminate as D

BPE = public_tokenizers.path("byte_bpe_50k.json")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_slices_keep_every_row(monkeypatch):
    monkeypatch.setattr(A, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 3, 25, 1, 0, 9, 9)] + [None]})
    assert pa.Table.from_batches(A.slices([batch, batch.slice(0, 0)])).to_pydict() == batch.to_pydict()


def test_words_stop_at_text_limits():
    words = D.words_of(pa.array(["ab", "cd", None, "", " x1 yz ", "é-É"]))
    assert np.diff(words.first).tolist() == [1, 1, 0, 0, 2, 2]
    same = D.words_of(pa.array(["AB ab abab"]))
    assert same.hash[0] == same.hash[1] != same.hash[2]


# --- BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(BPE)


def test_bpe_equals_the_library(codec):
    r = random.Random(1)
    parts = [*"ab cdeZ 'st'll\n\n  \t.!?--\"09 é ß ñ  　’日本\x85\x1c\x1f​ 😀", "'s", "'re", "<|endoftext|>", "<|endo", "\r\n", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", "a" * 3000, " " * 2000, "é" * 300, "ab" * 2000, "=" * 777, "<|endoftext|>", "x<|endo", "ftext|>"]
    ids, limit = codec.encode(*A.texts(pa.array(texts)))
    library = Tokenizer.from_file(BPE)
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[i:j].tolist() for i, j in zip(limit, limit[1:])] == [e.ids for e in expected]
    raw, at = codec.spelled(ids, limit, codec.token)
    assert [raw[i:j].decode() for i, j in zip(at, at[1:])] == [library.decode(e.ids, skip_special_tokens=False) for e in expected]


def test_bpe_forgets_and_goes_on(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    library = Tokenizer.from_file(BPE)
    for k in range(3):
        text = prose(k, 50)
        ids, _ = codec.encode(*A.texts(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark):
    out = sorted((tuple(r) for r in bpe.round_trip(docs(spark), BPE).collect()), key=str)
    library = Tokenizer.from_file(BPE)
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert out == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs(spark), BPE), BPE).collect()
    assert sorted((r.text, r.doc_id is None) for r in back) == sorted((r[1] or "", r[0] is None) for r in rows())
    broken = bpe.decode(spark.createDataFrame([(1, [255]), (2, None)], "doc_id long, ids array<int>"), BPE).collect()
    assert {r.doc_id: r.text for r in broken} == {1: Tokenizer.from_file(BPE).decode([255]), 2: ""}
    assert bpe.round_trip(nothing(spark), BPE).collect() == []
    assert len(bpe.tokenized(docs(spark), BPE).collect()) == len(rows())


# --- decontamination


def brute_report(pairs, items):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").encode().lower())
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(str(item))
    out = []
    for doc, text in pairs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, prose(1, 120)[50:300]),
    (2, prose(1, 120)[50:300]),
    (10, prose(3, 40).upper()),
    (3, "two three"),
    (4, "Ä"),
    (5, None),
    (6, "--"),
    (None, "one"),
    (7, prose(2, 6000)[2000:20000]),
    (8, "日本語" * 30),
]


@pytest.mark.parametrize("block_words", [1 << 18, 20])
def test_contamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id long, text string, doc_id int")
    out = sorted((tuple(r) for r in D.contamination(docs(spark), items).collect()), key=str)
    assert out == brute_report([(r[0], r[1]) for r in rows()], ITEMS)
    clean = D.uncontaminated(docs(spark), items)
    assert clean.columns == docs(spark).columns and clean.count() == sum(not r[-1] for r in out)


def test_longest_matches(spark):
    words = prose(21, 60).split()
    item = " ".join(words)
    text = " ".join(["x", *words[5:40], "y", *words[10:25], *words[:12]])
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = D.longest_matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), items).collect()
    assert {(r.doc_word, r.item_word, r.n_words) for r in found} == {(1, 5, 35), (37, 10, 15), (52, 0, 12)}


def test_empty_benchmark(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs(spark), items).where("contaminated").count() == 0
    assert D.contamination(nothing(spark), items).collect() == []
    assert D.longest_matches(docs(spark), items).collect() == []


# --- licences


def test_licence_spellings(spark):
    same = [
        "Licensed under the Apache License, Version 2.0.",
        "licenced under Apache Licence version 2",
        "Copyright (c) 2020 Someone\nThis software is licensed under the apache license v2.0",
        "LICENSED UNDER -- the Apache\n  License; version 2.0",
    ]
    texts = [(k, t) for k, t in enumerate(same)] + [(10, "prose\nReleased under the MIT License.\nprose"), (11, None), (12, ""), (13, "Copyright 2020"), (None, same[0])]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, digest string")
    out = licences.scan(df, licences.known_licences(spark)).collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert {by[k].licence for k in (0, 1, 2, 3, None)} == {"Apache-2.0"} and len({by[k].digest for k in (0, 1, 2, 3)}) == 1
    assert (by[10].licence, by[10].line_licences) == (None, "MIT")
    assert all((by[k].digest, by[k].licence, by[k].line_licences) == (None, None, "") for k in (11, 12, 13))
    assert licences.scan(nothing(spark), licences.known_licences(spark)).collect() == []


def test_licence_lines_without_the_word_and_beside_a_copyright(spark):
    lines = {
        "Released under the GPL v3": "GPL-3.0",
        "Distributed under CC BY 4.0.": "CC-BY-4.0",
        "Available under CC0 1.0": "CC0-1.0",
        "Copyright 2020 X. Licensed under the MIT License.": "MIT",
        "Copyright (c) 2019-2021 J. Smith, all rights reserved. Released under the MIT License": "MIT",
        "Licensed under the MIT License. © 2020 X": "MIT",
        "Copyright Someone. All rights reserved.": "",
        "Copyright 2020 X": "",
    }
    df = spark.createDataFrame([(k, f"prose\n{t}\nmore prose") for k, t in enumerate(lines)], "doc_id long, text string")
    out = {r.doc_id: r.line_licences for r in licences.scan(df, licences.known_licences(spark)).collect()}
    assert [out[k] for k in range(len(lines))] == list(lines.values())


def test_full_licence_texts(spark):
    mit = dict(licences.TEXTS)["MIT"].split("\n", 1)[1]
    texts = {1: ("MIT", f"MIT Licence\n\nCopyright (c) 2020 Someone\n\n{mit.replace(chr(10), ' ')}")}
    for k, (name, file) in enumerate((("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0")), 2):
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            texts[k] = (name, path.read_text())
    df = spark.createDataFrame([(k, t) for k, (_, t) in texts.items()], "doc_id long, text string")
    out = {r.doc_id: r.licence for r in licences.scan(df, licences.known_licences(spark)).collect()}
    assert out == {k: n for k, (n, _) in texts.items()}


def test_licence_sql_states_the_same_rule(spark):
    """Rows that a narrower rule would miss, and statements of copyright of all kinds."""
    mit = dict(licences.TEXTS)["MIT"]
    texts = [
        "Copyright 2020 X. Licensed under the MIT License.", "Distributed under CC BY 4.0", mit, mit.replace("\n", " "),
        "Copyright the holders of it\nReleased under the GPL v3", "copyright notice: available under CC0 1.0", "© 2020 Licensed under CC BY-SA 4.0",
        "-- Copyright\nCopyright Jane Doe\ncopyright (c) 1999 by all, all rights reserved. Provided under the BSD 2-Clause Licence",
        "Copyright 2020 a\rb Licensed under the MIT License\rmore", "understand the MIT\tLicense; Licensed\tunder  the MIT License!", None, "", "(c)",
        "Copyright 2001 A. Copyright 2002 B. This work is licensed under the Apache License, version 2 Copyright 2003 C",
    ]
    frame = spark.createDataFrame([(k if k % 4 else None, t) for k, t in enumerate(texts)] + [(1, texts[2])], "doc_id long, text string")
    con = duckdb.connect()
    given = pa.table({"doc_id": [r[0] for r in frame.collect()], "text": pa.array([r[1] for r in frame.collect()], pa.string())})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    assert differences(licences.scan(frame, licences.known_licences(spark)), con, licences.scan_sql()) == []


def test_licence_words_pass_every_line_that_matches(spark):
    """Known texts without the stem are found by a word of theirs, and any text by the empty word."""
    known = licences.known_licences(spark, (("A", "Permission to use is yours"), ("B", "do it"), ("C", "zero licences")), ())
    frame = spark.createDataFrame([(1, "x\npermission, to use is yours"), (2, "x\nDo it!\ny"), (3, "y\nzero licenses")], "doc_id long, text string")
    assert {r.doc_id: r.line_licences for r in licences.scan(frame, known).collect()} == {1: "A", 2: "B", 3: "C"}
    assert set(known.where("licence = 'B'").first().words) == {""}


# --- personal data


def test_examples_of_every_kind_stay_beside_a_text_full_of_numbers(spark):
    r = random.Random(6)
    texts = [(k, f"call +49 170 {1000000 + 7919 * k} or mail a{k}@mail.org, words {k}") for k in range(80)]
    texts += [(100, "; ".join("".join(r.choice("123456789") for _ in range(14)) for _ in range(4000)))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = pii.examples(df, 100).collect()
    assert len(got) == 2000
    assert sum(e.y == 1 and e.x[0] == pii.KINDS.index("phone") for e in got) == 160
    assert pii.train(df, 100).limit[pii.KINDS.index("phone")] < 2


def slow_base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans():
    r = random.Random(2)
    parts = [*"ab.@-_%+ 0123456789().é\n,"]
    for _ in range(30000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        assert pii.base_matches(text)[0] == slow_base(text)
    for text in ("9" * 40000, "1." * 20000, "a@" * 20000, "a" * 40000 + "@x", "+1" + "(" * 40000):
        pii.base_matches(text)  # linear, so it ends


def private(n):
    r = random.Random(5)
    out = []
    for k in range(n):
        body = "4" + "".join(str(r.randint(0, 9)) for _ in range(14))
        card = next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))
        plain = body + str((int(card[-1]) + 5) % 10)
        out.append(
            (k, f"{prose(k, 20)} write to user{k}@mail.example.com or call +1 (555) 555-{r.randint(1000, 9999)}, host 10.0.{k % 250}.7, "
                f"card {card} not {plain}; order {r.randint(10**8, 10**9)} of {prose(k + 1, 8)}")
        )
    return out


def test_selected_spans_keep_the_base_and_find_rewritten_ones(spark):
    df = spark.createDataFrame(private(200), "doc_id long, text string")
    selector = pii.train(df)
    out = {r.doc_id: r for r in pii.find(df, selector).collect()}
    for k, text in private(200):
        base = slow_base(text)
        assert (out[k].n_email, out[k].n_ip, out[k].n_card, out[k].n_phone) == (1, 1, 1, 1)
        assert out[k].base_sha256 == sha(pii.joined(base).encode())
        assert set(pii.joined(base).split(",")) == set(out[k].spans.split(","))
    text = "please mail someone (at) mail.example.com today"
    assert pii.redact(text, selector) == "please mail [EMAIL] today"


def test_redaction(spark):
    df = docs(spark).union(spark.sql("SELECT 77L, 'é a@b.cd, 10.0.0.1!', 'en', 's', 18, 'x', 1L, 1, 1, 1L"))
    out = pii.redacted(df, pii.train(df))
    assert out.columns == df.columns and out.count() == len(rows()) + 1
    row = out.where("doc_id = 77").first()
    assert row.text == "é [EMAIL], [IP]!" and row.n_chars == len(row.text)
    assert out.where("doc_id = 6").first().text is None
    assert pii.personal_data(nothing(spark)).collect() == []


# --- classifiers


def labelled(n):
    r = random.Random(9)
    out = []
    for k in range(n):
        text, good, toxic = prose(k, r.randint(5, 80)), r.random() < 0.8, r.random() < 0.2
        if not good:
            text = " | ".join(text.split()) if k % 2 else " ".join(w + "###" for w in text.split())
        if toxic:
            text += " " + r.choice(["grumble", "snarl", "growl"]) + " " + prose(k + 1, 5)
        out.append((k, text, int(good), int(toxic)))
    return out


@pytest.mark.parametrize("operator, label, column, sure", [(quality.quality, "quality", 2, 0.7), (toxicity.toxicity, "toxic", 3, 0.3)])
def test_held_out_accuracy(spark, operator, label, column, sure):
    made = labelled(1200)
    df = spark.createDataFrame([(r[0], r[1], "x", 1) for r in made], "doc_id long, text string, label string, score int")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in made], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (5, None, None), (999999, 0, 0)], labels.schema)
    out = operator(df, labels.union(odd)).collect()
    assert len(out) == len(made) and sum(r.held_out for r in out) > 200
    truth = {r[0]: r[column] for r in made}
    right = [r.predicted == truth[r.doc_id] for r in out if r.held_out]
    assert np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= sure) for r in out)


@pytest.mark.parametrize("operator, label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, operator, label):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert operator(nothing(spark), none).collect() == []
    out = operator(docs(spark), none).collect()
    assert len(out) == len(rows()) and all(r.held_out is not None for r in out)
    one = spark.createDataFrame([(k, 1) for k in range(1, 14)], f"doc_id long, {label} int")
    assert all(r.score > 0.99 for r in operator(docs(spark), one).collect())


def test_linear_time_pairs_equal_the_double_sum():
    machine = quality.Machine(np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), 0.3)
    r = np.random.RandomState(2)
    machine.w = r.normal(size=machine.w.shape)
    feature, value = np.array([3, 90, 5000, 16384, 16390]), r.normal(size=5)
    out, _ = machine.raw(feature, value, np.zeros(5, dtype=int), 1)
    slow = 0.3 + sum(machine.w[f] * x for f, x in zip(feature, value))
    for i in range(5):
        for j in range(i + 1, 5):
            slow += machine.v[feature[i]] @ machine.v[feature[j]] * value[i] * value[j]
    assert abs(out[0] - slow) < 1e-9


def test_block_max_search_is_exact():
    made = labelled(900)
    word, n, first = toxicity.counted(pa.array([r[1] for r in made]))
    words = [word[i:j] for i, j in zip(first, first[1:])]
    counts = [n[i:j] for i, j in zip(first, first[1:])]
    index = toxicity.Index(np.arange(900), np.array([r[3] for r in made]), words, counts, 0.2)
    assert set(index.term.tolist()) == set(word.tolist())  # every word of the examples
    row = np.repeat(np.arange(900), np.diff(first))
    best, place = index.nearest(*index.query(word, n, row, 900), 900)
    dense = np.zeros((900, len(index.term)))
    dense[row, np.searchsorted(index.term, word)] = (1 + np.log(n)) * index.weight[np.searchsorted(index.term, word)]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    cosine = dense @ dense.T
    want = -np.sort(-cosine, axis=1)[:, : toxicity.K]
    assert np.allclose(best, want, atol=1e-9)
    assert np.allclose(best[:, 0], 1)  # each example finds itself, or one that is equal in its words
    assert all(abs(cosine[i, p] - b) < 1e-9 for i in range(900) for p, b in zip(place[i], best[i]) if p >= 0)
    one, _ = index.nearest(*index.query(np.append(word[: first[1]], np.uint64(7)), np.append(n[: first[1]], 3), np.zeros(first[1] + 1, dtype=int), 1), 1)
    assert 0.9 < one[0, 0] < 1  # a word that no example holds lengthens the text's vector only


def test_spans_that_base_patterns_miss_are_found(spark):
    """Planted forms of each kind, held out of training: phones and cards run on into other numbers, spelled signs and dots."""
    r = random.Random(21)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + digit(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    def phone():
        return f"+1 ({digit(3)}) 555-{digit(4)}"

    def ip():
        return ".".join(str(r.randint(1, 255)) for _ in range(4))

    made = []
    for k in range(900):
        item = [card, phone, ip, lambda: f"{prose(k, 1)}{k}@mail{k % 7}.example.com"][k % 4]()
        made.append((k, f"{prose(k, 9)} {item} {prose(k + 1, 9)} {digit(16) if k % 3 == 0 else ''}"))
    selector = pii.train(spark.createDataFrame(made, "doc_id long, text string"))
    planted = {kind: 0 for kind in pii.KINDS}
    wrong = 0
    for k in range(200):
        forms = {"phone": (phone(), " " + ip()), "card": (card(), " " + digit(5))}
        forms |= {"ip": (ip().replace(".", "[.]"), ""), "email": (f"{prose(k, 1)}{k} (at) mail{k % 5}.example.com", "")}
        for kind, (form, behind) in forms.items():
            text = f"{prose(k + 2, 8)} {form}{behind} {prose(k + 3, 8)}"
            base, failed = pii.base_matches(text)
            added = set(selector.select(text, base, failed)) - set(base)
            start = text.index(form)
            right = (start, pii.KINDS.index(kind), start + len(form))
            planted[kind] += right in added
            wrong += len(added - {right})
    assert min(planted.values()) >= 180, planted
    assert wrong <= 16
    for clean in ("version 1.2.3 of 2024", "order 1234567 at (at) noon", "three rolls (at) 12.50 each", "@handle met us", "9807915762804490 is no card"):
        assert selector.select(clean, *pii.base_matches(clean)) == []


def test_parts_of_a_failed_match():
    text = "+1 (826) 555-4081 190.137.223.204"
    base, failed = pii.base_matches(text)
    assert base == [(18, 1, 33)] and (0, 3, 17) in pii.proposals(text, base, failed)
    long_ = "1 " * 20000  # groups without end are searched in linear time
    assert pii.base_matches(long_)[0] == [] and len(pii.proposals(long_, *pii.base_matches(long_))) < 200000


def test_equal_examples_vote_in_the_order_of_their_ids():
    word, n, first = toxicity.counted(pa.array(["snarl at the old gate"] * 40 + ["walk to the old gate"] * 40))
    words, counts = [word[i:j] for i, j in zip(first, first[1:])], [n[i:j] for i, j in zip(first, first[1:])]
    index = toxicity.Index(np.arange(100, 180), np.array([1] * 40 + [0] * 40), words, counts, 0.5)
    scores, evidence = index.scores(pa.array(["Snarl at the old gate", "walk to the old gate", None, "", "zzz"]))
    assert evidence == [[100, 101, 102], [140, 141, 142], [], [], []]
    assert scores[0] > 0.99 and scores[1] < 0.01 and scores[2] == scores[3] == scores[4] == 0.5


def test_language_of_held_out_rows(spark):
    r = random.Random(3)
    syllables = {"aa": "ka to mi ne ru so", "bb": "str ing est ou tch", "cc": "ия ов на ст ра"}
    made = []
    for k in range(600):
        lang = r.choice(list(syllables))
        words = ["".join(r.choice(syllables[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(30)]
        made.append((k, " ".join(words), lang))
    made += [(1000, None, "aa"), (1001, "12 34 !", "aa"), (1002, "kato mine", None), (None, "kato", "bb"), (1003, "", "bb")]
    out = language.predict_languages(spark.createDataFrame(made, "doc_id long, text string, lang string")).collect()
    by = {x.doc_id: x for x in out}
    assert len(out) == len(made) and all(0 <= x.score <= 1 for x in out)
    assert all(by[k].lang_pred == lang for k, _, lang in made[:600])
    assert [by[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "aa", "und"]


def test_out_of_place_distance():
    ranks = language.Ranks([("x", 10, 0), ("x", 20, 1), ("x", 30, 2), ("y", 20, 0)])
    found = np.array([20] * 3 + [10] * 2 + [99])
    lang, score = ranks.best(found)  # own order 20, 10, 99; x is 1 + 1 + absent away, y 0 + two absent
    assert lang == "x" and abs(score - (1 - (2 + language.PROFILE) / (3 * language.PROFILE))) < 1e-12


def test_language_odd_rows(spark):
    assert language.predict_languages(nothing(spark)).collect() == []
    untaught = docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.predict_languages(untaught).collect()} == {"und"}
