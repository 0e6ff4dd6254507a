"""The training-data operators against brute force, and on awkward tables: nulls, empty and long texts, repeats, no rows, clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import duckdb
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quire.llm import hilbert, jaccard, licenses, mixing, mpeg, packing, prefixcount, quality, tokenfile, warc, wordbpe  # noqa: E402
from quire.llm.components import components  # noqa: E402

BPE = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("row", "size", "salt", "place", "votes", "key", "mark", "digest", "node", "n", "rank", "length", "media", "t", "words", "k", "d", "start")


def awkward() -> list[tuple]:
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the and river stone light walks under green of a to is house".split()) for _ in range(n)) + "."
    base = prose(120)
    near = base.replace("river", "RIVER", 1)
    texts = [None, "", " ", "\n\n", "a", "one two three", prose(30), prose(300), prose(6000), base, base, near, base, "x" * 5000, "é🙂中 ß\u0000z", "<|endoftext|> a", "the the the the the the the the the the the " * 5, "Licensed under the Apache License, Version 2.0.\nmore", None]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t or "") if i % 4 else None) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, prose(40), None, None, None), (None, base, "en", "s1", 3), (7, prose(50), "en", "s0", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(awkward(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1. media columns


def test_mpeg_stores_and_reads_back(docs, none):
    got = mpeg.stored_features(docs).toPandas()
    assert len(got) == docs.count() and mpeg.stored_features(none).count() == 0
    texts = Counter()
    for i, t, *_ in awkward():
        raw = (t or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        texts[i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])] += 1
    own = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got.itertuples())
    assert own == texts
    assert all("crc=" in f and "/0;resyncs=0" in f and "Xing:True:True" in f for f in got.feature)


def test_mpeg_resynchronises():
    payload = mpeg.padded(b"hello world " * 700)
    stream = mpeg.write_stream(payload)
    found = mpeg.parse(stream)
    assert mpeg.ancillary(stream, found) == payload and found["duration_us"] == found["n_samples"] * 1_000_000 // 44100
    assert [mpeg.header(stream, at)["size"] for at in found["frame_offsets"]] == [f["size"] for f in found["frames"]]
    at = found["frame_offsets"][3]
    broken = mpeg.parse(stream[:at] + b"junk\xff\xfbmore" + stream[at:])
    assert broken["n_frames"] == found["n_frames"] and broken["resyncs"] == 1 and broken["skipped_bytes"] == 10 and broken["table_agrees"] is False
    flipped = bytearray(stream)
    flipped[at + 10] ^= 1
    assert (mpeg.parse(bytes(flipped))["crc_bad"], mpeg.parse(bytes(flipped))["crc_ok"]) == (1, found["crc_ok"] - 1)
    empty = mpeg.parse(b"")
    assert empty["n_frames"] == 0 and empty["duration_us"] is None and mpeg.parse(b"\xff" * 900)["n_frames"] == 0


@pytest.mark.parametrize(("head", "size", "samples"), [(b"\xff\xfd\x80\x00", 417, 1152), (b"\xff\xff\x90\x00", 312, 384), (b"\xff\xf3\x80\x00", 208, 576), (b"\xff\xe3\x80\x00", 417, 576)])
def test_mpeg_headers_of_other_kinds(head, size, samples):
    h = mpeg.header(head, 0)
    assert (h["size"], h["samples"]) == (size, samples)


@pytest.mark.parametrize(("head", "size", "step", "samples", "hz"), [(b"\xff\xfb\x00\x00", 500, 1, 1152, 44100), (b"\xff\xfd\x04\xc0", 1000, 1, 1152, 48000), (b"\xff\xff\x08\x00", 400, 4, 384, 32000), (b"\xff\xf3\x00\x40", 300, 1, 576, 22050)])
def test_mpeg_free_format(head, size, step, samples, hz):
    """Frames that don't tell their bitrate, with and without padding, behind junk, and cut off."""
    rng = random.Random(8)
    pads = [rng.random() < 0.5 for _ in range(20)]
    frame = lambda pad: (head[:2] + bytes([head[2] | 2 * pad]) + head[3:]).ljust(size + pad * step, b"\x00")
    stream = b"".join(map(frame, pads))
    for before in (b"", b"junk\xff\xe0" * 3):
        got = mpeg.parse(before + stream)
        starts = [len(before) + sum(size + p * step for p in pads[:k]) for k in range(20)]
        assert got["frame_offsets"] == starts and got["n_samples"] == 20 * samples and got["sample_rate"] == hz and got["duration_us"] == 20 * samples * 1_000_000 // hz
        assert got["min_kbps"] == round(size * hz / (samples * 125)) and got["skipped_bytes"] == len(before)
    assert mpeg.parse(stream[:-1])["n_frames"] == 19 and mpeg.parse(frame(True))["n_frames"] == 0


def test_mpeg_tags():
    frame = b"\xff\xfb\x90\x00".ljust(417, b"\0")
    vbri = frame[:36] + b"VBRI" + b"\0\1\0\0\0\0" + struct.pack(">II", 3 * 417, 2) + frame[54:]
    ape_item = struct.pack("<II", 3, 0) + b"Artist\0abc"
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(ape_item) + 32, 1, 0) + bytes(8)
    v1 = b"TAG" + b"song".ljust(30, b"\0") + bytes(94) + b"\xff"
    found = mpeg.parse(vbri + frame + frame + ape_item + foot + v1)
    assert found["vbr_table"] == "VBRI" and found["table_agrees"] and found["n_frames"] == 2
    assert found["tags"] == {"ID3v1:title": "song", "APE:Artist": "abc"}


def test_mpeg_layer_two_checksums():
    """Allocations and selections of every table, against a bit by bit count."""
    rng = random.Random(4)
    heads = [(b"\xff\xfc", i << 4 | r << 2, m << 6 | x << 4) for i in range(1, 15) for r in range(3) for m in (0, 1, 3) for x in (0, 3)] + [(b"\xff\xf4", 8 << 4 | r << 2, m << 6) for r in range(3) for m in (0, 3)]
    tables = set()
    for head, second, third in heads:
        first = head + bytes((second, third))
        h = mpeg.header(first, 0)
        body = bytearray(rng.randbytes(h["size"]))
        body[:4] = first
        bits = "".join(f"{b:08b}" for b in body[6:])
        sizes, at, used = mpeg.allocation(h), 0, 0
        tables.add((len(sizes), sum(sizes)))
        bound = min(len(sizes), 4 * (h["ext"] + 1) if h["joint"] else 32)
        for sb, n in enumerate(sizes):
            for own in range(h["channels"] if sb < bound else 1):
                used += (int(bits[at : at + n], 2) > 0) * (1 if sb < bound else h["channels"])
                at += n
        c = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in body[2:4]) + bits[: at + 2 * used]:
            c = (c << 1 ^ (0x8005 if (c >> 15) ^ int(bit) else 0)) & 0xFFFF
        body[4:6] = c.to_bytes(2, "big")
        assert mpeg._checksum(bytes(body), mpeg.header(bytes(body), 0)) is True
        body[4] ^= 1
        assert mpeg._checksum(bytes(body), mpeg.header(bytes(body), 0)) is False
    assert tables == {(12, 38), (8, 26), (27, 88), (30, 94), (30, 75)}


def test_mpeg_older_and_unsynchronised_tags():
    frame = b"\xff\xfb\x90\x00".ljust(417, b"\0")
    size = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    text = "a\u00ff".encode("latin-1") + b"\xe0b"
    v22 = b"TT2" + (len(text) + 1).to_bytes(3, "big") + b"\0" + text + b"TXX" + (8).to_bytes(3, "big") + b"\0own\0val"
    plain = text.decode("latin-1")
    for flags, body in ((0, v22), (0x80, v22.replace(b"\xff", b"\xff\0"))):
        found = mpeg.parse(b"ID3\x02\0" + bytes((flags,)) + size(len(body)) + body + frame * 2)
        assert found["tags"] == {"TT2": plain, "TXXX:own": "val"} and found["n_frames"] == 2 and not found["skipped_bytes"]
    inner = b"\0" + text.replace(b"\xff", b"\xff\0")
    v24 = b"TIT2" + size(len(inner) + 4) + bytes((0, 3)) + size(len(text) + 1) + inner
    assert mpeg.parse(b"ID3\x04\0\x80" + size(len(v24)) + v24 + frame * 2)["tags"] == {"TIT2": plain}
    items = b"".join(struct.pack("<II", 1, 0) + f"K{i}".encode() + b"\0v" for i in range(1500))
    foot = b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 1500, 0) + bytes(8)
    assert len(mpeg.parse(frame * 2 + items + foot)["tags"]) == 1500


def test_mpeg_tables_are_held_against_frames():
    stream = mpeg.write_stream(mpeg.padded(b"payload " * 9000))
    found = mpeg.parse(stream)
    at = stream.index(b"Xing") + 16
    wrong = stream[: at + 50] + bytes((stream[at + 50] ^ 0x40,)) + stream[at + 51 :]
    assert found["seek_agrees"] is True and mpeg.parse(wrong)["seek_agrees"] is False and found["table_crc_ok"] is None
    frame = b"\xff\xfb\x90\x00".ljust(417, b"\0")
    tag = bytearray(frame)
    tag[36:44], tag[156:160] = b"Info" + bytes(4), b"LAME"
    crc = 0
    for b in tag[:190]:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    tag[190:192] = crc.to_bytes(2, "big")
    assert mpeg.parse(bytes(tag) + frame * 3)["table_crc_ok"] is True
    tag[20] ^= 1
    assert mpeg.parse(bytes(tag) + frame * 3)["table_crc_ok"] is False
    vbri = lambda points: frame[:36] + b"VBRI" + bytes(6) + struct.pack(">IIHHHH", 7 * 417, 6, len(points), 1, 2, 2) + b"".join(struct.pack(">H", p) for p in points) + frame[62 + 2 * len(points) :]
    assert mpeg.parse(vbri([834, 834, 834]) + frame * 6)["seek_agrees"] is True and mpeg.parse(vbri([834, 400, 834]) + frame * 6)["seek_agrees"] is False


def test_mpeg_media_column(spark):
    df = spark.createDataFrame([(1, mpeg.write_stream(b"x" * 64), "k"), (2, None, None)], "id int, media binary, mpeg_note string")
    got = {r.id: r for r in mpeg.parse_media(df, payload=True).collect()}
    assert got[1].mpeg.n_frames == 1 and bytes(got[1].payload) == b"x" * 64 and got[1].mpeg_note == "k" and got[2].mpeg is None


# 2. packing


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 2048])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 5)])) for _ in range(rng.choice([0, 1, 50, 900]))]
    total, slots = packing.plan(dict(Counter(lengths)), capacity)
    assert total == best_fit(lengths, capacity)
    held = defaultdict(list)
    for length, lo, hi, first, each, at in slots:
        for r in range(lo, hi):
            held[first + (r - lo) // each].append((at + (r - lo) % each * length, length))
    assert len(held) == total and Counter(x for v in held.values() for _, x in v) == Counter(lengths)
    for places in held.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= capacity


def ids_of(text):
    return wordbpe.WordIds(BPE).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing(docs, none):
    got = packing.pack(docs, BPE, 64).toPandas()
    want = Counter()
    for i, t, *_ in awkward():
        ids = [*ids_of(t), 0]
        for n, s in enumerate(range(0, len(ids), 64)):
            part = ids[s : s + 64]
            want[i, n, s, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    assert got.sequence_id.nunique() == best_fit(got.length.tolist(), 64)
    assert packing.pack(none, BPE).count() == 0


# 3. licenses


def test_licenses(spark, docs, none):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n\n#     http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'
    bsd = "Copyright (c) 2020 Someone. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    texts = [apache, bsd, "no license here", "junk before\nReleased under the MIT License.\nand after. Licensed under CC BY-NC 4.0.", None, "You may obtain a copy of the License at"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].licenses for i in range(6)] == ["Apache-2.0", "BSD-2-Clause", "", "MIT,CC-BY-NC-4.0", "", ""]
    assert got[0].n_known == 6 and got[5].unmatched_ids == "ApacheCopyAt" and got[4].n_sentences == 0
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(none).count() == 0
    normal = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    assert all(normal(s) == s for s in licenses.SENTENCES.values()) and len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert {n for _, r in licenses.RULES for p in r.split() for n in p.rstrip("?").split("|")} <= {*licenses.SENTENCES, "Copyright", "%", *(name for name, _, _ in licenses.CLAUSES)}


GNU = """This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License as published by
the Free Software Foundation{either} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name}General Public License for more details.

You should have received a copy of the GNU {name}General Public License
along with this {what}.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at {}://mozilla.org/MPL/2.0/.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial"}
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
TITLES = [
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", "GPL-2.0-only"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "GPL-3.0-only"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1-only"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", "LGPL-3.0-only"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0-only"),
    ("Mozilla Public License Version 2.0", "MPL-2.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("The Artistic License 2.0", "Artistic-2.0"),
]
HOLDERS = ["Google Inc.", "the University of California", "the Foo Project", "Foo, Bar & Co.", "Jane Q. Public"]
ADVERT = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the Foo Project.
"""
LIABLE = """
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.
"""
GNU_ONLY = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {name}General Public License version {version} as
published by the Free Software Foundation.
"""
#: Tags and what they say.
TAGS = [
    ("MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("(BSD-3-Clause AND MIT)", "(BSD-3-Clause AND MIT)"), ("GPL-2.0+", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("LGPL-2.1+ OR (MIT AND GPL-3.0)", "LGPL-2.1-or-later OR (MIT AND GPL-3.0-only)"),
    ("Apache-2.0 WITH LLVM-exception", "Apache-2.0 WITH LLVM-exception"), ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only WITH Classpath-exception-2.0"), ("LicenseRef-mine", "LicenseRef-mine"), ("MIT and more", "MIT"),
]
#: A notice as it is published, and its licence.
NOTICES = [
    (APACHE, "Apache-2.0"),
    (BSD + BSD_AS_IS, "BSD-2-Clause"),
    (BSD + ENDORSE + BSD_AS_IS, "BSD-3-Clause"),
    (BSD + ADVERT + ENDORSE.replace("3.", "4.") + BSD_AS_IS, "BSD-4-Clause"),
    (BSD + "\n3. Whoever reads this must send a postcard.\n" + BSD_AS_IS, "LicenseRef-BSD"),
    (BSD + "\n3) Whoever reads this must send a postcard.\n" + BSD_AS_IS, "LicenseRef-BSD"),
    *((BSD + ENDORSE.replace("the copyright holder", h) + BSD_AS_IS.replace("THE COPYRIGHT HOLDERS", h.upper()) + LIABLE.replace("THE COPYRIGHT HOLDER", h.upper()), "BSD-3-Clause") for h in HOLDERS),
    *((BSD + BSD_AS_IS.replace("THE COPYRIGHT HOLDERS", h.upper()) + LIABLE.replace("THE COPYRIGHT HOLDER", h.upper()), "BSD-2-Clause") for h in HOLDERS),
    *((GNU_ONLY.format(name=name, version=v), f"{spdx}-{v + '.0' * (v != '2.1')}-only") for name, spdx, v in (("", "GPL", "2"), ("", "GPL", "3"), ("Lesser ", "LGPL", "2.1"), ("Lesser ", "LGPL", "3"), ("Affero ", "AGPL", "3"))),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    ("Dual licensed under the MIT License and the Apache License, Version 2.0.", "MIT OR Apache-2.0"),
    ("Licensed under either of the Apache License, Version 2.0 or the MIT license, at your option.", "Apache-2.0 OR MIT"),
    (MIT, "MIT"),
    (ISC, "ISC"),
    (GNU.format(what="program", mark=";", name="", either=";", version="2"), "GPL-2.0-or-later"),
    (GNU.format(what="program", mark=":", name="", either=",", version="3"), "GPL-3.0-or-later"),
    (GNU.format(what="library", mark=";", name="Lesser ", either=";", version="2.1"), "LGPL-2.1-or-later"),
    (GNU.format(what="library", mark=";", name="Lesser ", either=";", version="3"), "LGPL-3.0-or-later"),
    (GNU.format(what="program", mark=":", name="Affero ", either=",", version="3"), "AGPL-3.0-or-later"),
    (MPL.format("http"), "MPL-2.0"),
    (MPL.format("https"), "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    (ZLIB, "Zlib"),
    (ZERO_BSD, "0BSD"),
    (BOOST, "BSL-1.0"),
    (EPL, "EPL-2.0"),
    ("Licensed under the Artistic License 2.0.", "Artistic-2.0"),
    *((f"{title}\n\nwhat follows is long", name) for title, name in TITLES),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Released under the MIT License.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"),
    ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under CC0 1.0.", "CC0-1.0"),
    *((f"Licensed under CC {c} 4.0.", f"CC-{c}-4.0") for c in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA")),
    *((f"This work is licensed under a Creative Commons {n} 4.0 International License.", f"CC-{c}-4.0") for c, n in CC.items()),
    *((f"SPDX-License-Identifier: {n}", n) for n in sorted({n for n, _ in licenses.MORE_RULES + licenses.RULES})),
]


def scanned(spark, texts):
    return [r for _, r in sorted((r.doc_id, r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())]


def test_every_licence_is_found_by_its_notice(spark):
    commented = ["\n".join(f" * {line}".rstrip() if line else "" for line in t.split("\n")) for t, _ in NOTICES]
    for texts in ([t for t, _ in NOTICES], commented):
        got = scanned(spark, texts)
        assert [(r.licenses, r.unmatched_ids) for r in got] == [(n, "") for _, n in NOTICES]
    assert {n for _, n in NOTICES if " OR " not in n} == {n for n, _ in licenses.MORE_RULES + licenses.RULES}
    used = {i for r in scanned(spark, [t for t, _ in NOTICES]) for i in r.sentence_ids.split(",")}
    used = {i for i in used if ":" not in i}
    rest = {"ApacheCopyUrl", "Gpl2OnlyWord", "Gpl3OnlyOf", "Lgpl21OnlyOf", "Lgpl3OnlyOf", "MitLicensed", "MitTitle", "MitTitleThe", "Gpl2Licensed", "Gpl3Licensed", "Agpl3Licensed"}
    assert used | rest == {*licenses.SENTENCES, *licenses.MORE_SENTENCES, *(name for name, _, _ in licenses.CLAUSES)} | {"Copyright"} & used
    # Marks elsewhere end sentences as before.
    assert [r.n_sentences for r in scanned(spark, ["I came; either way. v. Chr. 3: x", "a v.\nb; c"])] == [6, 3]


def test_licence_expressions(spark):
    texts = [f"{mark}SPDX-License-Identifier: {said}{end}\nint main;" for said, _ in TAGS for mark, end in (("// ", ""), ("/* ", " */"), ("# ", ""))]
    assert [r.licenses for r in scanned(spark, texts)] == [want for _, want in TAGS for _ in range(3)]


def test_licence_scan_sql(spark, docs):
    """The SQL knows all that the scan knows."""
    texts = [t for t, _ in NOTICES] + ["\n".join(f" * {line}".rstrip() for line in t.split("\n")) for t, _ in NOTICES] + [f"# SPDX-License-Identifier: {t}\nx" for t, _ in TAGS]
    texts += ["x.c does things\nCopyright (C) 2020 X\n2021 Y\nAll rights reserved\n" + t for t, _ in NOTICES] + ["Copyright 2020 X and\nothers\nCopyright 2021 Y", "copyright", None, "", "the copyright notice\nCopyright 20201 Z\n20222"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, n_sentences, n_known, sentence_ids, licenses, unmatched_ids FROM ({licenses.oracle()})").fetchall()}
    got = {r.doc_id: tuple(r) for r in licenses.scan(df).collect()}
    assert [i for i in got if got[i] != want[i]] == []


def test_parts_far_apart_are_no_licence(spark):
    first, second = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", BSD[BSD.index("2. Red") :]
    grant = BSD[: BSD.index("1. Red")]
    other = "Nothing known. "
    near, far = (grant + other * n + first + "\n" + other * n + second for n in (licenses.GAP - 1, licenses.GAP + 1))
    got = scanned(spark, [near, far, other * 100_000 + MIT, grant])
    assert [r.licenses for r in got] == ["BSD-2-Clause", "", "MIT", ""]
    assert got[1].unmatched_ids == "BsdGrant,BsdSource,BsdBinary" and got[2].n_sentences > 100_000
    words = licenses.anchors(licenses.SENTENCES | licenses.MORE_SENTENCES)
    assert all(set(s.split()) & set(words) for s in [*licenses.SENTENCES.values(), *licenses.MORE_SENTENCES.values()]) and len(words) < 12


def test_copyright_lines_hide_no_licence(spark):
    shaped = [t for t in NOTICES if t[1] in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-or-later")]
    texts, want = [], []
    for text, name in shaped:
        for head in ("Copyright 2024 Foo\n", "Copyright (c) 2020 X\nCopyright (c) 2021 Y\n          2022 Z\nAll rights reserved\n", "x.c does things\nCopyright (C) 2020 X\n"):
            for gap in ("", "\n"):
                for mark in ("", "# ", " * ", "// ", "-- "):
                    texts.append("\n".join(f"{mark}{line}".rstrip() for line in f"{head}{gap}{text}".split("\n")))
                    want.append(name)
    got = scanned(spark, texts)
    assert [(t, r.licenses) for t, r in zip(texts, got, strict=True)] == list(zip(texts, want, strict=True))
    assert all(r.sentence_ids.count("Copyright") == 1 for r in got)
    # Text wrapped before the word is no notice; notices in a row of any length are one, those with other lines between aren't.
    wrapped = MIT.replace("The above copyright", "The above\ncopyright").replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT")
    alone = "Copyright 2020 X and\nothers\nCopyright 2021 Y"
    got = scanned(spark, [wrapped, "Copyright 2020 X\n" * 50_000 + wrapped, "Copyright 2020 X\nAll rights reserved.", "copyright", "Copyright", alone])
    assert [(r.sentence_ids, r.licenses) for r in got[2:]] == [("Copyright", ""), ("", ""), ("", ""), ("Copyright,Copyright", "")]
    assert got[0].sentence_ids == "MitGrant,MitNotice,MitAsIs,MitLiable" and got[1].sentence_ids == "Copyright,MitGrant,MitNotice,MitAsIs,MitLiable"
    assert (got[0].licenses, got[1].licenses, got[1].unmatched_ids) == ("MIT", "MIT", "")


# 4. token files


def test_token_files(spark, docs, none, tmp_path):
    manifest = tokenfile.write_shards(docs, BPE, f"file://{tmp_path}", shards=4)
    got = tokenfile.read_shards(spark, manifest).toPandas()
    order = sorted(((i, t) for i, t, *_ in awkward()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = [*ids_of(t), 1]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    own = sorted(((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got.itertuples()), key=lambda r: r[1])
    assert own == want
    asked = spark.createDataFrame([(3,), (6,), (999,), (-5,), (None,)], "doc_id long")
    found = {r.doc_id: r.ids for r in tokenfile.lookup(asked, manifest).collect()}
    assert found[6] == [*ids_of(awkward()[6][1]), 1] and found[3] == [1] and found[999] is None and found[-5] is None and found[None] is None
    assert tokenfile.token_shards(none, BPE).count() == 0
    (tmp_path / manifest[0]["ids"].rpartition("/")[2]).write_bytes(b"\0\0")
    with pytest.raises(Exception, match="bytes; its index tells"):
        tokenfile.read_shards(spark, manifest).collect()


def test_ties_go_by_the_whole_text(spark):
    """Rows of one key with one beginning are stored in one order, however they are dealt."""
    rows_ = [(1, "x" * 80 + f" tail {k}" * (k + 1)) for k in range(12)]
    starts = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows_[:: 1 if parts == 1 else -1], "doc_id long, text string").repartition(parts)
        starts.append(sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_shards(df, BPE).collect()))
    assert starts[0] == starts[1] and len(starts[0]) == 12


def test_shards_follow_bytes_and_rows(spark, none, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_BYTES", 1000)
    empty = spark.range(100).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    long_ = spark.createDataFrame([(1, "é" * 2000), (2, None)], "doc_id long, text string")
    assert [tokenfile.shard_count(d, "text") for d in (none, empty, long_)] == [1, 7, 5]
    monkeypatch.setattr(tokenfile, "MOST_SHARDS", 3)
    assert tokenfile.shard_count(empty, "text") == 3
    got = sorted(tuple(r) for r in tokenfile.token_shards(empty, BPE).collect())
    assert [r[:3] for r in got] == [(i, i, 1) for i in range(100)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    mph = tokenfile.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def test_words_encode_as_whole_texts():
    rng, coder = random.Random(1), wordbpe.WordIds(BPE)
    bits = ["'s", "don't", "É", "é", " ", "\t", "\x1c", "　", "İ", "ΑΣ", "<|endoftext|>", "A", "ß", "12", "...", "\n", "\r\n", "\x85", "中", "🙂", "ﬁ", "x" * 40, " ", "word,", "Word."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    ids, ends = coder.encode(pa.array([*texts, None]))
    whole = coder.tokenizer.encode_batch([*texts, ""], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in whole]
    byte_level = wordbpe.WordIds(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert not byte_level.by_word and byte_level.encode(pa.array(["a b", None]))[0].tolist() == byte_level.tokenizer.encode("a b").ids


# 5. Hilbert shards


def test_hilbert_curves_are_bounded():
    with pytest.raises(ValueError, match="cells"):
        hilbert.curve(5, 5)


def test_hilbert_curve_is_a_curve():
    for bits, dims in ((2, 2), (3, 3), (1, 4)):
        cells = {p: c for c, p in hilbert.curve(bits, dims)}
        point = lambda c: [c >> bits * d & (1 << bits) - 1 for d in range(dims)]  # noqa: E731, B023
        assert sorted(cells) == list(range(1 << bits * dims))
        assert all(sum(abs(a - b) for a, b in zip(point(cells[i]), point(cells[i + 1]), strict=True)) == 1 for i in range(len(cells) - 1))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_hilbert_shards(docs, none, law):
    got = hilbert.assign(docs, 5, law).toPandas()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in awkward())
    assert Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.size, r.text_crc32) for r in got.itertuples()) == want
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    if law == "rows":
        sizes = got.groupby("shard").size()
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
    assert got.sort_values(["shard", "slot"]).curve_place.is_monotonic_increasing
    assert hilbert.assign(none, 5, law).count() == 0


def test_hilbert_places_follow_the_quantiles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cuts = hilbert.quantiles(docs)
    number = lambda v: v.encode() if isinstance(v, str) else v
    got = {r.doc_id: r.curve_place for r in hilbert.assign(docs).collect()}
    for r in docs.collect():
        point = tuple(1 + sum(number(r[d]) > number(c) for c in cuts[k]) for k, d in enumerate(hilbert.DIMENSIONS))
        assert got[r.doc_id] == hilbert.curve_index(point, hilbert.BITS)


def test_hilbert_pruning(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hilbert.write_shards(docs, str(tmp_path / "out"), 8)
    written = spark.read.parquet(str(tmp_path / "out"))
    keep = [r.shard for r in hilbert.prune(hilbert.zone_map(written), {"lang": ("de", "de"), "n_chars": (0, 500)}).collect()]
    wanted = written.where("lang = 'de' AND n_chars <= 500")
    assert written.count() == docs.count() and len(keep) < 8 and wanted.count() == wanted.where(F.col("shard").isin(keep)).count()


def test_hilbert_writes_exactly_its_rows(spark, docs, tmp_path):
    """Null and repeated keys, repeated rows, and columns that have the names of its own."""
    df = docs.withColumns({"shard": F.lit("own"), "slot": F.lit(1), "s_": F.lit(2), "place": F.lit("p")})
    name = hilbert.write_shards(df, str(tmp_path / "out"), 5)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and written.columns == [*df.columns, name]
    key = lambda frame: Counter(map(repr, rows(frame.select(*df.columns))))
    assert key(written) == key(df)
    sizes = [r["count"] for r in written.groupBy(name).count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("values", [40, 900])
def test_string_cuts_look_at_whole_values(spark, values):
    """Strings that share a long beginning: exact quantiles, and a bucket each where there are few."""
    rng = random.Random(values)
    names = [f"https://example.org/{rng.randrange(10**6)}" for _ in range(values)]
    rows_ = [rng.choice(names) for _ in range(3000)] + [names[0]] * 1500
    df = spark.createDataFrame([(x,) for x in rows_] + [(None,)], "source string").repartition(5)
    cuts, ordered = hilbert.string_cuts(df, "source", 31), sorted(rows_)
    want = sorted({ordered[-(-len(ordered) * k // 31) - 1] for k in range(1, 31)} - {ordered[-1]})
    assert cuts == want
    few = df.where(F.col("source").isin(names[:9]))
    assert hilbert.string_cuts(few, "source", 31) == sorted({x for x in rows_ if x in names[:9]})[:-1]
    assert hilbert.string_cuts(df.where("false"), "source", 31) == []


# 6. quality


def brute_features(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + k for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_features(docs, none):
    got = quality.judge(docs).collect()
    want = Counter((i, *brute_features(t)) for i, t, *_ in awkward())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_finds_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet"))
    both = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").toPandas()
    assert (both.kept == (both.quality == 1)).mean() > 0.97
    assert both[both.quality == 1].kept.mean() > 0.99


def test_quality_model_recovers_accuracies():
    rng = random.Random(3)
    good, bad = [0.97, 0.95, 0.9, 0.99], [0.7, 0.8, 0.6, 0.5]
    counts = Counter()
    for _ in range(20_000):
        y = rng.random() < 0.75
        counts["".join("-" if rng.random() < 0.1 else str(int((rng.random() < (g if y else 1 - b)))) for g, b in zip(good, bad, strict=True))] += 1
    prior, g, b = quality.fit(counts)
    assert abs(prior - 0.75) < 0.05 and max(abs(x - y) for x, y in zip(g, good, strict=True)) < 0.05 and max(abs(x - y) for x, y in zip(b, bad, strict=True)) < 0.12
    assert quality.fit({}) and quality.posterior("----", 0.6, good, bad) == pytest.approx(0.6)


# 7. mixing


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(most * sizes[s], weight[s] * mid) for s in order) < share * sum(sizes.values()):
            lo = mid
        else:
            hi = mid
    return {s: min(most * sizes[s], weight[s] * lo) for s in order}


def test_targets():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {s: rng.choice([0, 5, 100, 10_000]) * rng.randint(1, 9) for s in [*"abcdefg"[: rng.randint(1, 7)], None]}
        if sum(sizes.values()):
            got, want = mixing.targets(sizes), brute_targets(sizes)
            assert all(got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6) for s in sizes)


def test_permutations_and_draws():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))
    quotas = np.asarray([50, 0, 700, 33])
    parts = [mixing.shard_counts(quotas, 64, k, 5) for k in range(-(-783 // 64))]
    assert (sum(c for _, c in parts) == quotas).all() and [int(c.sum()) for _, c in parts] == [64] * 12 + [15]
    at = np.zeros(4, int)
    for before, counts in parts:
        assert (before == at).all()
        at = at + counts
    for n in (1, 2, 3, 100, 1025):
        assert mixing.place_of(mixing.permuted(np.arange(n), n, 9), n, 9).tolist() == list(range(n))


@pytest.mark.parametrize(("good", "bad", "n"), [(30, 70, 20), (12, 3, 9), (500, 900, 1000), (4 * 10**8, 5 * 10**8, 10**8), (4 * 10**8, 7 * 10**8, 10**8), (4 * 10**11, 10**11, 3 * 10**10)])
def test_draws_follow_one_law_at_every_size(good, bad, n):
    """Also on both sides of the bound of numpy's own draw."""
    rng, times = np.random.default_rng(n), 3000
    got = np.asarray([mixing._draw(rng, good, bad, n) for _ in range(times)], float)
    whole = good + bad
    mean, var = n * good / whole, n * (good / whole) * (bad / whole) * (whole - n) / (whole - 1)
    assert abs(got.mean() - mean) < 4 * (var / times) ** 0.5 and 0.9 < got.var() / var < 1.1
    assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)
    sure = mixing._split(np.asarray([good, bad, 5]), n, rng)
    assert int(sure.sum()) == n and mixing._draw(rng, good, bad, whole) == good and mixing._draw(rng, good, bad, 0) == 0


@pytest.mark.parametrize("size", [1, 5, 16, 17, 100, 1000])
def test_quotas_meet_their_words(size):
    for words in {0, 1, size // 3, size - 1, size, size + 1, 3 * size // 2, 2 * size}:
        slots, off = mixing.quota(size, words, 16, 7, 3)
        n, held = -(-size // 16), 0
        for k in range(slots):
            block = int(mixing.permuted(np.asarray([k % n]), n, mixing.pass_key(7, 3, k // n))[0])
            held += min(16, size - 16 * block) - (off if k == slots - 1 else 0)
        assert held == words and 0 <= off < 16


def test_copies_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 3)
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("d", 20)], "k string, n long")
    got = Counter((r.k, r.copy) for r in mixing.copies(df).collect())
    assert got == Counter((k, i) for k, n in (("a", 1), ("b", 3), ("c", 4), ("d", 20)) for i in range(n))


def test_mix_of_hot_rows(spark):
    """A third of all rows empty, a third one row again and again: each is a document, and no two lists are compared."""
    rows_ = [(None, None, "s", "x", 0)] * 400 + [(5, "one two three four five", "s", "x", 9)] * 400 + [(i, f"w{i} " * 9, "s", "x", 9) for i in range(400)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, lang string, n_chars long").repartition(4)
    got = mixing.Mix(df, block=16, per_shard=64).by_document().toPandas()
    assert len(got) == 1200 and got.taken.sum() == int(1.5 * (2000 + 3600)) and (got.taken <= 2 * got["size"]).all()
    mixed = mixing.mixed_documents(df, block=16, per_shard=64).collect()
    assert sum(len(WORD.findall(r.text)) for r in mixed) == got.taken.sum() and all(r.lang == "x" for r in mixed)
    layout = mixing.Mix(df, block=16, per_shard=64).layout().toPandas()
    assert (layout.hi - layout.lo).sum() == got.taken.sum()


def test_mix(spark, docs, none):
    got = mixing.Mix(docs, block=16, per_shard=50).by_document().toPandas()
    again = mixing.Mix(docs.repartition(7), block=16, per_shard=50).by_document().toPandas()
    key = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).values.tolist()))
    assert key(got) == key(again) and len(got) == docs.count()
    assert (got.taken <= 2 * got["size"]).all()
    sizes = Counter()
    for _, t, _, s, _ in awkward():
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    assert sorted(set(got.source_size)) == sorted(set(sizes.values()))
    by = got.groupby("source_size").agg(t=("target", "first"), k=("taken", "sum"))
    for size, r in by.iterrows():
        assert any(n == size and abs(want[s] - r.t) < 1e-3 for s, n in sizes.items()) and r.t - 1 - 1e-6 <= r.k <= r.t + 1e-6
    assert mixing.Mix(none).by_document().count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_hold_the_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(3))
    mixed = mixing.mixed_documents(docs, block=32)
    assert mixed.schema.simpleString() == docs.schema.simpleString()
    texts, words = docs.toPandas().set_index("doc_id").text.to_dict(), Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    taken = mixing.Mix(docs, block=32).by_document().groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()
    assert {r.doc_id: r.n for r in taken if r.n} == dict(words)


# 8. token counts


def test_prefix_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = prefixcount.prefix_table(docs, PIECES)
    got = prefixcount.with_limit(table, 100).collect()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in awkward())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got) and prefixcount.prefix_table(none, PIECES).count() == 0
    kept = prefixcount.prefixes_within(table.where("doc_id IN (6, 14)").dropDuplicates(["doc_id"]), [0, 5, 10**6]).collect()
    texts = {i: t for i, t, *_ in awkward() if i in (6, 14)}
    for r in kept:
        counts = [len(model.encode(texts[r.doc_id][: k + 1])) for k in range(len(texts[r.doc_id]))]
        assert r.keep == max([k + 1 for k, c in enumerate(counts) if c <= r.budget], default=0)


def test_every_prefix_counts():
    import sentencepiece

    model, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), prefixcount.PrefixCounts(PIECES), random.Random(4)
    bits = [" ", "  ", "a", "aa", "the", "▁", "\n", "\t", "中", "🙂", "<s>", "ing", "é", "=", "----", "0", "\r", "\x00", "tion", "."]
    for _ in range(400):
        s = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert own.counts(s).tolist() == [len(model.encode(s[:i])) for i in range(1, len(s) + 1)], s


# 9. Jaccard join


def brute_links(pairs):
    sets = [(lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(WORD.findall(t or "")) for _, t in pairs]
    n = len(pairs)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            same = (pairs[i][1] or "") == (pairs[j][1] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    out = [None] * n
    for g in groups.values():
        ids = [pairs[i][0] for i in g if pairs[i][0] is not None]
        for i in g:
            out[i] = (pairs[i][0], min(ids) if ids else None, links[i])
    return Counter(out)


def test_jaccard_join(docs, none):
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links([(i, t) for i, t, *_ in awkward()])
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and jaccard.keep_one(none).count() == 0
    assert kept.count() == len({(r.component) for r in jaccard.linked(docs).collect()})


def test_jaccard_join_in_small_tiles(spark, monkeypatch):
    """Groups larger than a tile, and many pairs at once."""
    monkeypatch.setattr(jaccard, "TILE", 7)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(words) for _ in range(80)) for _ in range(40)]
    pairs = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(pairs)


def test_jaccard_join_of_repeated_rows_and_null_keys(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(500)]
    near = lambda w: " ".join(["other", *w[1:]])
    a, b, c = ([rng.choice(words) for _ in range(120)] for _ in range(3))
    pairs = [(1, " ".join(a))] * 5 + [(2, near(a))] + [(None, " ".join(b)), (None, " ".join(b)), (3, near(b))] + [(None, " ".join(c)), (None, near(c))]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    got = jaccard.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(pairs)
    kept = jaccard.keep_one(df)
    assert kept.count() == 3
    plan = kept._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange hashpartitioning(k#")
    assert "row_number(), 1, Final" in plan[:dealt] and "row_number(), 1, Partial" in plan[dealt:]  # repeated rows aren't dealt


def test_jaccard_join_where_chunks_are_empty(spark, monkeypatch):
    """Few texts, so long that their group has more chunks than texts in some."""
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 150)
    rng = random.Random(3)
    texts = []
    for g in range(12):
        w = [f"g{g}w{rng.randrange(500)}" for _ in range(200)]
        texts += [" ".join([*w[:-1], f"end{k}"]) for k in range(2 + g % 2)]
    pairs = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(pairs)


def test_pruning_bound():
    from math import comb

    need = jaccard.least_matches(16, 0.8, 1e-6)
    tail = lambda m: sum(comb(17, k) * 0.8**k * 0.2 ** (17 - k) for k in range(m + 1))
    assert tail(need) >= 1e-6 > tail(need - 1)


@pytest.mark.parametrize("range_", [64, 1 << 18])
def test_shared_counts_agree(monkeypatch, range_):
    monkeypatch.setattr(jaccard, "RANGE", range_)
    rng = np.random.default_rng(0)
    every = rng.integers(0, 1 << 64, 300, np.uint64)
    sets = [np.unique(rng.choice(every, 80)) for _ in range(29)] + [np.unique(every)[:1]]
    i, j = np.nonzero(np.triu(np.ones((30, 30), bool), 1))
    assert jaccard.shared(sets, sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    i, j = (x.ravel() for x in np.indices((18, 12)))
    assert jaccard.shared(sets[:18], sets[18:], i, j).tolist() == [len(np.intersect1d(sets[a], sets[18 + b])) for a, b in zip(i, j, strict=True)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(35)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hot_star(spark, monkeypatch):
    """A centre that has nearly all edges, whose least neighbour is anywhere: its neighbours are dealt to many parts."""
    from quire.llm import components as module

    rng = random.Random(9)
    ids = rng.sample(range(10**6), 2000)
    edges = spark.createDataFrame([(500_000, x) for x in ids if x != 500_000] + [(x, x + 10**7) for x in ids[:50]], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert set(got.values()) == {min([*ids, 500_000])} and len(got) == len({*ids, 500_000}) + 50
    parts = module.with_least(edges).select("m").distinct().collect()
    assert min(r.m for r in parts) == min(x for x in ids if x != 500_000)
    plan = module.with_least(edges)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "hashpartitioning(a#" in plan


def test_packing_splits_repeated_rows(spark):
    rows_ = [(1, "one two three")] * 300 + [(2, "four")] * 5
    got = packing.pack(spark.createDataFrame(rows_, "doc_id long, text string").repartition(6), BPE, 16).toPandas()
    assert len(got) == 305 and got.groupby(["sequence_id", "offset"]).size().max() == 1
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 16
    assert got.sequence_id.nunique() == best_fit(got.length.tolist(), 16)


# 10. WARC


def test_warc(spark, tmp_path):
    long, html = "é" * 60, "x" * 99
    pages = [(5, "u5", long), (3, "u3", long), (9, None, long), (1, "u1", html), (2, "u2", html), (4, "a\r\nb", None), (6, "u6", ""), (None, "u", long), (None, "u", "only" * 50), (7, "u7", "q" * 300), (7, "u7", "q" * 300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "digest", "n", "id", "first_id", "header", "told")})
    warc.write_archive(df, str(tmp_path / "a"))
    records = warc.read_records(spark, str(tmp_path / "a"))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.parse_records(records).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    revisit = {(5, long), (9, long), (None, long)}
    assert got == Counter((i, len((t or "").encode()), sha(t), "revisit" if (i, t) in revisit else "response", 3 if (i, t) in revisit else None) for i, _, t in pages)
    stored = spark.read.parquet(str(tmp_path / "a" / "payloads"))
    assert stored.count() == len({sha(t) for _, _, t in pages})
    record = bytes(records.where("decode(header, 'UTF-8') LIKE '%page:3>%' AND decode(header, 'UTF-8') LIKE '%Type: response%'").first().record)
    head, _, rest = record.partition(b"\r\n\r\n")
    assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4 and rest.endswith(long.encode() + b"\r\n\r\n")
    stored.withColumn("payload", F.lit(b"changed")).write.parquet(str(tmp_path / "b" / "payloads"))
    spark.read.parquet(str(tmp_path / "a" / "headers")).write.parquet(str(tmp_path / "b" / "headers"))
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_records(spark, str(tmp_path / "b")).collect()
    assert warc.archived(df.where("false")).count() == 0
