"""Operators on documents against brute force on small corpora, with odd rows."""

import hashlib
import math
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneleffect.llm import common, decontam, jaccard, langid, licences, linededup, packing, queries, repeats, sharding, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text, lower):
    raw = (text or "").encode()
    return WORD.findall(raw.translate(LOWER) if lower else raw)


def least(links, nodes):
    up = {k: k for k in nodes}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {k: find(k) for k in nodes}


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_are_runs_outside_white_space():
    data = "Ab  c\x0bd\x85e é\n".encode() + b"x"
    offsets = np.array([0, len(data) - 1, len(data), len(data)])
    starts, ends, before = common.word_spans(np.frombuffer(data, np.uint8), offsets)
    assert [data[a:b] for a, b in zip(starts, ends)] == [*WORD.findall(data[:-1]), b"x"]
    assert before.tolist() == [0, 4, 5, 5]
    one = common.word_hashes(np.frombuffer(b"Word word", np.uint8), np.array([0, 5]), np.array([4, 9]), True)
    assert one[0] == one[1]


# --- licences


def test_licence_rules_take_the_longest_run_first(frame):
    head = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n\n    http://example.org\n"
    wrapped = "This Source Code Form is subject to\nthe terms of the mozilla Public License, v. 2.0."
    rows = [(1, head), (2, "Text.\nReleased under the MIT License.\nMore."), (3, None), (4, ""), (5, "Nothing"), (6, wrapped.replace("mozilla", "Mozilla")), (7, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), (7, "Released under the MIT License. Licensed under CC BY-NC 4.0.")]
    out = licences.scan(frame(rows)).collect()
    got = sorted((r["doc_id"], r["licences"], r["left_over"]) for r in out)
    assert got == [(1, "Apache-2.0", ""), (2, "MIT", ""), (3, "", ""), (4, "", ""), (5, "", ""), (6, "MPL-2.0", ""), (7, "", "mitNotice"), (7, "MIT CC-BY-NC-4.0", "")]


def test_every_known_sentence_is_recognised(frame):
    rows = [(k, f"Some words.\n{text}\n") for k, (_, text) in enumerate(licences.SENTENCES)]
    out = rows_of(licences.scan(frame(rows)))
    assert [out[k]["sentence_ids"] for k in range(len(rows))] == [name for name, _ in licences.SENTENCES]

def published():
    """The notices as published, one string per paragraph."""
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."]
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."]
    hope = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    free = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    unlicense = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
    zlib_ = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    return [
        ("MIT", mit), ("Apache-2.0", apache), ("GPL-3.0-or-later", [free.format(":", "", ",", 3), hope]), ("GPL-2.0-or-later", [free.format(";", "", ";", 2), hope]),
        ("LGPL-3.0-or-later", [free.format(":", "Lesser ", ",", 3)]), ("BSD-2-Clause", bsd), ("BSD-3-Clause", [*bsd, third]), ("MPL-2.0", [mpl]), ("ISC", [isc]),
        ("ISC", [isc.replace("and/or", "and")]), ("0BSD", [isc.split(", provided")[0] + "."]), ("Unlicense", unlicense), ("Zlib", [zlib_]),
        ("LGPL-2.1-or-later", [free.format(";", "Lesser ", ";", 2.1), hope.replace("GNU", "GNU Lesser")]), ("AGPL-3.0-or-later", [free.format(":", "Affero ", ",", 3), hope.replace("GNU", "GNU Affero")]),
    ]


@pytest.mark.parametrize("sign", ["", " * ", "# ", "// ", "dnl ", "REM "])
@pytest.mark.parametrize("width", [72, 50])
def test_published_notices_are_found_wrapped_and_commented(frame, sign, width):
    rows = []
    for k, (_, paragraphs) in enumerate(published()):
        lines = ["Copyright (c) 2020 Somebody", ""]
        for paragraph in paragraphs:
            lines += [*textwrap.wrap(paragraph, width), ""]
        body = "\n".join((sign + line).rstrip() for line in lines)
        rows.append((k, f"/*\n{body}\n */\nint x;\n" if sign == " * " else body))
    rows += [(100, f"{sign}Licensed under CC BY 4.0.\r\n{sign}Released under the MIT License.\r\n"), (101, f"{sign}Released under\n\n{sign}the MIT License."), (102, f"{sign}Never released under the MIT License.")]
    out = rows_of(licences.scan(frame(rows)))
    want = {k: name for k, (name, _) in enumerate(published())} | {100: "MIT CC-BY-4.0", 101: "", 102: ""}
    assert {k: r["licences"] for k, r in out.items()} == want


def test_licence_scan_of_an_empty_table(frame):
    out = licences.scan(frame([]))
    assert out.count() == 0 and out.columns == ["doc_id", "sentence_ids", "licences", "n_sentences", "left_over"]


# --- line de-duplication


def brute_lines(rows, least_words=linededup.MIN_WORDS):
    every = []
    for doc, text in rows:
        if doc is not None and text is not None:
            every += [((doc, k), words(line, True)) for k, line in enumerate(text.split("\n"))]
    every = [(place, w) for place, w in every if len(w) >= least_words]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    return {p for p, w in every if any(q < p and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1 for q, v in every)}


def test_lines_match_brute_force(frame, prose):
    texts = [t and t.replace(" w1 ", "\n") for t in prose(3, 60, 8, 4, 40)]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)] + [(None, texts[0])]
    got = {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(frame(rows)).collect()}
    want = brute_lines(rows)
    assert want and got == want


def test_line_rules_for_odd_rows(frame):
    line = "One two three four five six"
    rows = [(1, line), (2, f"short\n{line.upper()} \n\n{line} seven"), (3, None), (4, ""), (5, "a b c d"), (6, "a b c d"), (None, line), (8, line.replace("three", "3"))]
    out = {(r["doc_id"], r["text"]) for r in linededup.without_repeats(frame(rows)).collect()}
    assert out == {(1, line), (2, "short\n"), (3, None), (4, ""), (5, "a b c d"), (6, "a b c d"), (None, line), (8, "")}
    assert {r["doc_id"] for r in linededup.reduced(frame(rows)).collect()} == {1, 2, 3, 4, 5, 6, None}
    assert linededup.reduced(frame([])).count() == 0


def test_short_lines_go_when_equal(frame, prose):
    texts = [t and t.replace(" w1 ", "\n") for t in prose(3, 60, 8, 1, 20)]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)] + [(200, "All rights\nw2"), (201, "ALL  rights \n\nall"), (None, texts[0])]
    got = {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(frame(rows), short=True).collect()}
    lines = [((d, k), words(line, True)) for d, t in rows if d is not None and t is not None for k, line in enumerate(t.split("\n"))]
    few = [(p, w) for p, w in lines if 0 < len(w) < linededup.MIN_WORDS]
    equal = {p for p, w in few if any(q < p and v == w for q, v in few)}
    assert (201, 0) in equal and got == brute_lines(rows) | equal


def test_lines_of_rows_that_repeat_an_id(frame):
    """Rows of one id with other texts: each line is compared as what it is, in any order of the rows."""
    a, b = "One two three four five six", "Seven eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a.replace("two", "2")), (3, b.replace("nine", "9")), (4, "Quite another line of words here")]
    for order in (rows, rows[::-1], [rows[k] for k in (3, 1, 4, 0, 2)]):
        got = {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(frame(order).repartition(3)).collect()}
        assert got == {(2, 0), (3, 0)}


def test_a_very_long_line_and_a_hot_one(frame):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, long), (2, long.replace("w777 ", "")), (3, long + " x y")] + [(k, "the same short line of words\nok") for k in range(10, 300)]
    got = {(r["doc_id"], r["line_no"]) for r in linededup.removed_lines(frame(rows), short=True).collect()}
    assert got == {(2, 0)} | {(k, n) for k in range(11, 300) for n in (0, 1)}


def test_the_pipeline_removes_equal_short_lines(spark):
    import corpus_pipeline

    line = "One two three four five six"
    docs = spark.createDataFrame([(1, f"{line}\nall rights reserved."), (2, "Kept words\nAll rights reserved."), (3, "all rights reserved.")], "doc_id long, text string")
    out = dict(corpus_pipeline.lines(spark, docs, "").collect())
    assert out == {1: f"{line}\nall rights reserved.", 2: "Kept words"}


def test_one_word_apart():
    near = linededup.within_one_word
    assert near(b"a b c", b"a x c") and near(b"a b c", b"a c") and near(b"a a", b"a a a") and near(b"", b"a")
    assert not near(b"a b c d", b"a c b d") and not near(b"a b", b"c d") and not near(b"a", b"a b c")


# --- language


@pytest.fixture(scope="module")
def labelled(spark):
    return common.read(spark, "/root/testdata/sf0.01", "documents")


def test_language_is_right_on_the_held_out_fold(labelled):
    out = langid.identify(labelled).join(labelled.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert sum(not r["accepted"] for r in out) <= 0.02 * len(out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_of_odd_rows(labelled, frame):
    model = langid.fit(labelled, langid.learnable())
    long = labelled.where("lang = 'de'").first()["text"] * 40
    rows = [(1, None), (2, ""), (3, "12 34 ... !!"), (4, long), (4, long), (None, "the and of that")]
    out = langid.predict(frame(rows), model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in out][:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert all(r["score"] == 0 and not r["accepted"] for r in out[:3]) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] for r in langid.accepted(frame(rows), model).collect()} <= {4, None}
    unlabelled = langid.identify(frame([(1, "text", None)], "doc_id long, text string, lang string"))
    assert unlabelled.first()["lang_pred"] == "und"


def test_strange_signs_are_rejected(labelled, frame):
    model = langid.fit(labelled, langid.learnable())
    rows = [(1, "搜索 引擎 数据 处理 分布式 计算"), (2, "данные поиск машина обучение")]
    assert langid.accepted(frame(rows), model).count() <= 1


# --- packing


def test_packing_is_a_round_trip(frame, prose):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*prose(5, 30), "a<|endoftext|>b  \n\n x", "naïve 漢字 🙂 it's 1234567", "word " * 3000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "id of its own")]
    out = packing.pieces(frame(rows).repartition(5)).collect()
    flat = sorted(out, key=lambda r: (r["sequence_id"], r["offset"]))
    at = 0
    for r in flat:
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["length"] == len(r["ids"]) <= 1024 - r["offset"]
        at += r["length"]
    for doc, text in rows:
        own = sorted((r for r in out if r["doc_id"] == doc), key=lambda r: r["start"])
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        assert [i for r in own for i in r["ids"]] == ids and {r["doc_tokens"] for r in own} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    whole = packing.sequences(packing.pieces(frame(rows))).collect()
    assert all(len(r["ids"]) == 1024 for r in whole) and len(whole) == math.ceil(at / 1024)
    assert packing.pieces(frame([])).count() == 0


# --- sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 257, 5000])
def test_permutation_and_its_inverse(n):
    numbers = np.arange(n)
    places = sharding.permuted(numbers, n)
    assert sorted(places.tolist()) == numbers.tolist()
    assert (sharding.restored(places, n) == numbers).all()


def test_shards_are_even_and_reproducible(frame, prose):
    texts = prose(7, 200)
    rows = [(k, t) for k, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "x"), (None, None)]
    out = sharding.assign(frame(rows)).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, ())) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert sorted(r["number"] for r in out) == list(range(len(rows)))
    content = lambda df: sorted((str(r["doc_id"]), r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in df.collect())
    assert content(sharding.assign(frame(rows[::-1]).repartition(7))) == sorted((str(r["doc_id"]), r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in out)
    known = {(k, t) for k, t in rows}
    want = sorted((str(k), zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for k, t in known | {(5, "again")})
    assert sorted({(str(r["doc_id"]), r["text_crc32"], r["size"]) for r in out}) == sorted(set(want))
    assert sharding.assign(frame([])).count() == 0


# --- n-gram Jaccard


def brute_jaccard(rows):
    sets, ids = [], sorted({k for k, _ in rows if k is not None})
    for doc, text in rows:
        w = words(text, True)
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    links = [
        (a, b)
        for i, (a, x) in enumerate(sets)
        for b, y in sets[:i]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return sets, least(links, ids)


@pytest.mark.parametrize("settings", [jaccard.Settings(), jaccard.Settings(block_rows=3, first_pairs=1, minima=1)])
def test_jaccard_matches_brute_force(frame, prose, settings):
    rows = [(k * 13 % 997, t) for k, t in enumerate(prose(11, 150, 60, 1, 120))]
    long = (" ".join(f"u{k}" for k in range(300))).split()
    rows += [(2000 + k, " ".join([*long[:k], f"x{k}", *long[k + 1 :]])) for k in range(0, 60)]
    rows += [(3000 + k, " ".join(long[: 300 - 12 * k])) for k in range(12)] + [(None, rows[0][1])]
    sets, want = brute_jaccard(rows)
    out = jaccard.classes(frame(rows), settings).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert sorted(r["n_shingles"] for r in out) == sorted(len(s) for _, s in sets)
    assert len(set(want.values())) < len(want)


def test_jaccard_tiles_alone_find_all_links_and_name_a_pair_in_few_tiles(frame, prose, monkeypatch):
    shared = [f"p{k}" for k in range(200)]  # a passage in texts that nearly link, in texts that do, and in long ones
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(28 + k % 9)] + shared + [f"b{k}x{j}" for j in range(2 * (k % 3))])) for k in range(60)]
    rows += [(100 + k, " ".join(shared[: 20 + 9 * k])) for k in range(20)] + [(200 + k, t) for k, t in enumerate(prose(5, 60, 50, 1, 90))]
    monkeypatch.setattr(jaccard, "_stars", lambda reps, *_: reps.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))
    compared, passed = jaccard._compared, []

    def counted(*args):
        out = compared(*args)
        passed.append(out.where("a is not null"))
        return out

    monkeypatch.setattr(jaccard, "_compared", counted)
    out = jaccard.classes(frame(rows), jaccard.Settings(block_rows=32, tile_rounds=1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_jaccard(rows)[1]
    for pairs in passed:
        assert pairs.count() <= 4 * pairs.select("a", "b").distinct().count()


def test_jaccard_keeps_one_of_each(frame):
    text = "a b c d e f g h i j"
    rows = [(3, text), (1, text.upper()), (2, None), (4, ""), (5, "a"), (6, "a"), (6, "a"), (None, text)]
    kept = jaccard.one_of_each(frame(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "5", "None"]
    assert jaccard.classes(frame([])).count() == 0


def test_bitmaps_fold():
    own = common.mixed(np.arange(1, 900, dtype=np.uint64))
    assert (jaccard.folded(jaccard.bitmap(own, 4096), 4) == jaccard.bitmap(own, 256)).all()


def test_prefix_blocks_come_back():
    edge = np.iinfo(np.int64)
    doc = np.array([5, 5, -7, edge.max, edge.min, 0, edge.min])
    columns = [np.arange(7) % 3 + 1, np.arange(7) << 44, doc, np.array([1, 2, 70_000, 300, 0, 1 << 40, 5])]
    assert (jaccard._unpacked(jaccard._packed(*columns)) == np.stack(columns)).all()
    assert jaccard._unpacked(jaccard._packed(*(c[:0] for c in columns))).shape == (4, 0)


def test_prefix_blocks_are_small():
    rng = np.random.default_rng(3)
    key, doc = rng.integers(0, 1 << 24, 30_000), np.sort(rng.integers(0, 200_000, 6_000)).repeat(5)
    block = jaccard._packed(np.ones(30_000, np.int64), key, doc, (doc * 31) % 900)
    assert len(block) < 5 * len(key)


def test_prefixes_are_not_stored_and_one_key_may_stand_for_many_shingles(frame, prose, monkeypatch):
    rows = [(k * 13 % 997, t) for k, t in enumerate(prose(11, 150, 60, 1, 120))]
    stored, stage = {}, common.stage

    def noted(df, name, by=()):
        stored[name] = df.columns
        return stage(df, name, by)

    monkeypatch.setattr(common, "stage", noted)
    monkeypatch.setattr(jaccard, "_stars", lambda reps, *_: reps.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0))
    monkeypatch.setattr(jaccard, "SPARE_BITS", -4, raising=False)
    out = jaccard.classes(frame(rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_jaccard(rows)[1]
    assert stored and not any("prefix" in columns for columns in stored.values())


def test_witnesses_are_smaller_keys_of_the_same_document():
    rng = np.random.default_rng(4)
    doc = rng.integers(0, 40, 900)
    key, n = rng.integers(0, 30, 900), doc * 3 + 1
    kept = list(zip(*(c.tolist() for c in jaccard._first_rows(key, doc, n, jaccard.Settings()))))
    for d in range(40):
        own = sorted(key[doc == d].tolist())
        own = own[: max(0, len(own) - max(1, (3 * d + 1) * 75 // 100 // 12) + 1)]
        rows = [r for r in kept if r[1] == d]
        assert [r[0] for r in rows] == own
        for k, _, size, *seen in rows:
            smaller = [x for x in own if x < k]
            assert size == 3 * d + 1 and seen[0] == max(smaller, default=-1)
            assert all(w in smaller if smaller else w == -1 for w in seen)
    assert all(not len(c) for c in jaccard._first_rows(key[:0], doc[:0], n[:0], jaccard.Settings()))


def test_jaccard_repeated_id_joins_the_sets_it_has(frame):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(3, a), (5, a), (5, b), (7, b), (8, "u v w x y z")]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classes(frame(rows)).collect()} == {3: 3, 5: 3, 7: 3, 8: 8}


def test_first_candidates_grow_with_the_components():
    for size in (10, 100, 400):
        x, y = np.triu_indices(size, 1)
        kept = jaccard._promising(x, y, np.random.default_rng(size).random(len(x)), 2)
        assert len(kept) <= 2 * size
        assert set(x[kept]) | set(y[kept]) == set(range(size))


# --- substring de-duplication


def brute_repeats(rows):
    seen, places = {}, []
    for doc, text in rows:
        w = words(text, False)
        for k in range(len(w) - 19):
            places.append(((doc, k), tuple(w[k : k + 20])))
    for place, window in places:
        if place[0] is not None:
            seen[window] = min(seen.get(window, place), place)
    gone = {}
    for (doc, k), window in places:
        if doc is not None and seen[window] < (doc, k):
            gone.setdefault(doc, set()).update(range(k, k + 20))
    out = []
    for doc, text in rows:
        w, drop = words(text, False), gone.get(doc, set())
        kept = b" ".join(x for k, x in enumerate(w) if k not in drop)
        out.append((str(doc), len(w), len([k for k in drop if k < len(w)]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("settings", [repeats.Settings(), repeats.Settings(slice_bytes=300, group_rows=2), repeats.Settings(group_rows=0)])
def test_repeats_match_brute_force(frame, prose, settings):
    texts = prose(13, 80, 12, 1, 90)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k * 17 % 211, t) for k, t in enumerate(texts)] + [(300 + k, f"x{k} {passage} y{k} {passage}") for k in range(40)]
    rows += [(None, passage), (400, "same " * 60), (401, "Same " * 60)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.digest(frame(rows).repartition(4), settings).collect())
    assert got == brute_repeats(rows)
    assert sum(r[2] for r in got) > 0


def test_repeats_of_odd_rows(frame):
    text = " ".join(f"p{k}" for k in range(25))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (5, "short")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.deduplicated(frame(rows)).collect())
    assert got == [(1, 25, 0, text), (1, 25, 0, text), (2, 25, 25, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 1, 0, "short")]
    assert repeats.deduplicated(frame([])).count() == 0


# --- benchmark decontamination


def brute_leak(item, text, most):
    x, y = decontam.characters(item), decontam.characters(text)
    row = [0] * (len(y) + 1)
    for i, c in enumerate(x.tolist(), 1):
        new = [i]
        for j, d in enumerate(y.tolist(), 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) if min(row) <= most else None


def test_leaks_match_brute_force(spark, frame):
    import random

    rng = random.Random(1)
    letters = "abcdefghij klmn opé"
    items = [(k, "".join(rng.choices(letters, k=rng.randint(30, 120)))) for k in range(12)] + [(90, None), (91, "short"), (92, "漢字" * 30)]
    rows = []
    for k in range(60):
        text = "".join(rng.choices(letters, k=rng.randint(0, 300)))
        if k % 2:
            own = list(rng.choice(items[:12] + items[-1:])[1])
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["z"], [own[at], "q"], [own[at].upper()]])
            text = text[:150] + "".join(own) + text[150:]
        rows.append((k, text.replace(" ", "\n") if k % 5 == 0 else text))
    rows += [(70, None), (71, ""), (None, items[0][1])]
    settings = decontam.Settings(piece_chars=128, min_chars=40)
    benchmark = frame([(i, t) for i, t in items], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.leaks(frame(rows), benchmark, settings).collect()}
    want = {}
    for doc, text in rows:
        for item, passage in items:
            if text and passage and len(passage) >= settings.min_chars:  # shorter ones have a test of their own
                edits = brute_leak(passage, text, int(settings.edit_share * len(passage)))
                if edits is not None:
                    want[doc, item] = edits
    assert found == want and len(want) > 10 and max(want.values()) > 0
    kept = {r["doc_id"] for r in decontam.clean(frame(rows), benchmark, settings).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    nothing = decontam.leaks(frame(rows), benchmark.where("false"), settings)
    assert nothing.count() == 0 and decontam.leaks(frame([]), benchmark, settings).count() == 0


def test_leak_spans_and_portions(frame):
    item = "The quick brown fox jumps over the lazy dog again and again"
    benchmark = frame([(7, item), (8, item), (9, "Another passage that has more than forty characters")], "item_id long, text string")
    rows = [(1, "x" * 50 + item.replace(" ", "\t").upper() + "y" * 9)]
    out = decontam.leaks(frame(rows), benchmark, decontam.Settings(portion_bytes=70)).collect()
    assert sorted((r["item_id"], r["edits"], r["start"], r["end"]) for r in out) == [(7, 0, 50, 50 + len(item)), (8, 0, 50, 50 + len(item))]


def test_short_items_are_found_as_whole_words(frame):
    items = [(1, "What is the capital of Peru?"), (2, "forty-two"), (3, "Ouagadougou"), (4, "no"), (5, " "), (6, None), (7, ""), (8, "É 9"), (9, "x" * 39)]
    texts = ["so: WHAT IS THE\tCAPITAL of peru?", "what is the capital of peru", "it is forty-two.", "forty-twos, aforty-two", "no", "No.", "nothing, piano", "(é 9)", "É 9", "é 99 É 9", "", None, "y" + "x" * 39, "- " + "x" * 39 + "\n"]
    benchmark = frame(items, "item_id long, text string")
    out = sorted((r["doc_id"], r["item_id"], r["edits"], r["start"], r["end"]) for r in decontam.leaks(frame(list(enumerate(texts))), benchmark).collect())
    assert out == [(0, 1, 0, 4, 32), (2, 2, 0, 6, 15), (4, 4, 0, 0, 2), (5, 4, 0, 0, 2), (8, 8, 0, 0, 3), (9, 8, 0, 5, 8), (13, 9, 0, 2, 41)]
    kept = {r["doc_id"] for r in decontam.clean(frame(list(enumerate(texts))), benchmark).collect()}
    assert kept == set(range(len(texts))) - {d for d, *_ in out}


def test_many_items_and_a_long_text_take_little_memory():
    import random
    import tracemalloc

    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(4000)]
    matcher = decontam.Matcher(items, decontam.Settings())
    text = " ".join(rng.choices(vocabulary, k=12_000)) + " " + items[77][1]
    tracemalloc.start()
    assert [k for k, *_ in matcher.find(text)] == [77]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


# --- toxicity


def test_toxicity_ranks_the_held_out_fold(spark):
    docs, labels = (common.read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.rate(labelled, labels).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in out if r["toxic"]], [r["score"] for r in out if not r["toxic"]]
    auc = np.mean([(p > np.array(neg)).mean() + 0.5 * (p == np.array(neg)).mean() for p in pos])
    caught = np.mean([r["predicted"] for r in out if r["toxic"]])
    wrong = np.mean([r["predicted"] for r in out if not r["toxic"]])
    assert auc > 0.93 and caught > 0.75 and wrong < 0.02


def test_toxicity_of_odd_rows(spark, frame):
    rows = [(k, ("nasty vile " if k % 2 else "kind soft ") * 3 + f"filler{k % 7} words here") for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(1, 0), (2, None), (3, 5), (None, 1)], "doc_id long, toxic int")
    odd = [(100, None), (101, ""), (102, "..."), (103, "nasty vile " * 5000), (103, "nasty vile " * 5000), (None, "kind soft")]
    out = toxicity.rate(frame(rows + odd), labels).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert [by[k]["score"] for k in (100, 101, 102)] == [0, 0, 0] and by[103]["predicted"] == 1 and by[None]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out if r["doc_id"] is not None)
    none = toxicity.rate(frame(rows), labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.rate(frame([]), labels).count() == 0


def test_toxicity_scores_follow_the_labelled_rows_not_the_sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1500):
        toxic = k % 10 == 0
        mark = "grim" if toxic or k % 10 in (1, 2, 3) else "mild"  # one grim text in four is toxic
        rows.append((k, " ".join([mark, *(f"w{x}" for x in rng.integers(0, 30, 12))]), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.rate(table.select("doc_id", "text"), table.select("doc_id", "toxic"), toxicity.Settings(slots=40)).collect()
    score = {r["doc_id"]: r["score"] for r in out}
    clean = [r["predicted"] for r in out if r["doc_id"] % 10]
    assert np.mean(clean) < 0.02 and abs(np.mean(list(score.values())) - 0.1) < 0.06
    assert 0.1 < np.mean([score[k] for k in score if k % 10 < 4]) < 0.45


def test_toxicity_calibrates_on_long_texts(spark):
    # Only long texts are clean and hold the mark, so short ones alone would call every mark toxic.
    rows = [(k, ("vile " if k % 3 == 0 else "") + f"a few plain words w{k % 11}", int(k % 3 == 0)) for k in range(300)]
    rows += [(k, "vile " + f"some plain words w{k % 11} " * 20, 0) for k in range(300, 1200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.rate(table.select("doc_id", "text"), table.select("doc_id", "toxic"), toxicity.Settings(longest=200)).collect()
    assert np.mean([r["predicted"] for r in out if r["doc_id"] >= 300]) < 0.02


# --- the registered queries


def test_registered_queries():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", ["op4_packing", "op5_sharding", "op10_decontamination"])
def test_queries_run_over_the_whole_table(spark, name):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    ids = out.select("doc_id").distinct().count()
    assert ids == 200 if name != "op10_decontamination" else ids > 0
