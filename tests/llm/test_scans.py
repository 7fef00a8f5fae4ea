"""Operators 2, 3, 4, 6, 8 and 10 against brute force, on fixtures and on the small tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkstone.llm import decontaminate, kernels, licenses, packing, quality, queries, secrets, sharding, tokens
from tests.llm.helpers import clashing, frame, invented

SF = "/root/testdata/sf0.01"


def documents(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# 2


def test_sharding_fixture(spark):
    texts = invented()
    out = sharding.shard_documents(clashing(frame(spark, texts))).collect()
    assert len(out) == len(texts)
    slots = defaultdict(list)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_ties_nulls_empty(spark):
    out = sharding.shard_documents(frame(spark, ["a"] * 40, ids=[1] * 20 + [None] * 20)).collect()
    assert len({r.shard for r in out if r.doc_id == 1}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in out}) == 40
    assert sharding.shard_documents(frame(spark, [])).count() == 0


def test_sharding_growth_and_balance(spark):
    df = spark.range(40000).withColumnRenamed("id", "doc_id")
    for n in (8, 9, 10):
        out = sharding.assign(df, sharding.topology(n), sharding.topology(n + 1)).groupBy("shard", "grown_shard").count().collect()
        assert all(r.grown_shard in (r.shard, n) for r in out)
        per = defaultdict(int)
        for r in out:
            per[r.shard] += r["count"]
        assert len(per) == n and max(per.values()) < 1.15 * 40000 / n and min(per.values()) > 0.85 * 40000 / n
    with pytest.raises(ValueError):
        sharding.topology(5)


def test_sharding_confines_movement_to_changed_subtrees(spark):
    df = spark.range(60000).withColumnRenamed("id", "doc_id")
    tree = sharding.topology(8)  # regions {0..3}, {4..7}; racks {0, 1}, {2, 3}, ...
    moves = lambda weights: {(r.shard, r.grown_shard): r["count"] for r in sharding.assign(df, tree, sharding.reweighted(tree, weights)).groupBy("shard", "grown_shard").count().collect()}
    # shard 1 gives to shard 0 what it loses: no total above their rack changes, so nothing outside the rack moves
    out = moves({"shard1": 0.5, "shard0": 1.5})
    assert {k for k in out if k[0] != k[1]} == {(1, 0)} and out[1, 0] == pytest.approx(60000 / 16, rel=0.1)
    # a heavier shard 5 only gains, in its rack, in its region and from the other region; nothing moves among the others but within its region
    out = moves({"shard5": 2.0})
    moved = {k for k in out if k[0] != k[1]}
    assert all(b in (4, 5, 6, 7) for _, b in moved) and (4, 5) in moved and not any(a in (0, 1, 2, 3) and b in (0, 1, 2, 3) for a, b in moved)
    per = [sum(n for (_, b), n in out.items() if b == s) for s in range(8)]
    assert per[5] == pytest.approx(60000 * 2 / 9, rel=0.06) and per[0] == pytest.approx(60000 / 9, rel=0.08)
    # a drained shard gives up its keys and takes none
    out = moves({"shard6": 0.0})
    assert not any(b == 6 for _, b in out)
    assert sharding.assign(df, sharding.reweighted(tree, {f"shard{i}": 0.0 for i in range(8)})).where("shard <> 0").count() == 0


# 3


def library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def assert_packed(rows, texts):
    ids = dict(enumerate(library(texts)))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for spans, goal in [(by_doc[d], len(ids[d])) for d in ids] + [(s, None) for s in by_seq.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at == goal if goal else at <= 1024
    return by_seq


def test_packing(spark):
    texts = invented(n=200) + ["don't  we'll\n\n he's 12ab '''s", "<|endoftext|> end", "a<|endoftext|>", "<|endoftext|>", "<|endoftext", "|> é<|endoftext|>日", "w " * 5000]
    assert_packed(packing.pieces(clashing(frame(spark, texts))).collect(), texts)
    assert packing.pieces(frame(spark, [])).count() == 0
    again = frame(spark, ["same text"] * 5, ids=[1] * 5)
    assert packing.pieces(again).count() == 5


def test_packing_has_little_padding(spark):
    texts = [t for _, t in sorted(documents(spark))]
    seqs = assert_packed(queries.op3_differencing_packing(spark, SF).collect(), texts)
    used = [sum(n for _, n in s) for s in seqs.values()]
    padding = sum(1024 - n for n in used if n & (n - 1))
    assert padding < 0.02 * sum(used)


def test_differencing():
    sizes = [8, 7, 6, 5, 4]
    at = packing.differencing(sizes, 2)
    assert sorted(np.bincount(at, weights=sizes)) == [14, 16]  # the known result of differencing (the best is 15, 15)
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 257, rng.integers(1, 200)).tolist()
        at, k = packing.pack(sizes)
        loads = np.bincount(at, weights=sizes, minlength=k)
        assert loads.max() <= 1024 and loads.sum() == sum(sizes) and k <= -(-sum(sizes) // 1024) + 2


def test_tokens_forget(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 60)
    import public_tokenizers as public

    code = tokens.Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    for t, want in zip(texts := [t for t in invented() if t], library(texts), strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        assert code.encode(raw, np.array([len(raw)]))[0].tolist() + [0] == want


# 4


def test_quality_on_small_tables(spark):
    out = {r.doc_id: r for r in queries.op4_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == 1000
    held = [(out[d].predicted, q) for d, q in labels.items() if out[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in out.items())
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_quality_cases(spark):
    good, bad = "the quiet river ran on and on", "BUY!!! NOW!!! $$$ ###"
    texts = [None, "", good, bad] + [good + str(i) if i % 2 else bad + str(i) for i in range(60)]
    labels = spark.createDataFrame([(i, 0 if i % 2 == 0 else 1, 0) for i in range(4, 64)] + [(5, None, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in quality.score(clashing(frame(spark, texts)), labels).collect()}
    assert out[0] == out[1] and out[2] > 0.8 and out[3] < 0.2
    none = quality.score(frame(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(frame(spark, []), labels).count() == 0
    kept = quality.keep_good(clashing(frame(spark, texts)), labels)
    assert kept.columns == clashing(frame(spark, texts)).columns
    assert bad not in [r.text for r in kept.collect()]


# 6


def base_spans(text):
    kinds = {
        "assign": (re.compile("(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(kinds.items()) for m in p.finditer(text) if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


SECRETS = [
    None, "", "password = hunter22", "token: token: abcdefgh", 'secret="short" secret="longer1"', "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 13, "é API_KEY=abc123 " + "0" * 24, "Toſen=abcdef toKen=abcdefg",
    "apikey : 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'", "f" * 23 + " " + "e" * 30, "http://u:pass1@h/ -----BEGIN RSA PRIVATE KEY-----abc", "PASSWD='''x", "password = hunter22",
]


def test_secrets(spark):
    def check(out, texts):
        assert len(out) == len(texts)
        for r in out:
            want = base_spans(texts[r.doc_id] or "")
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[0] == k for w in want) for k in secrets.BASE)
            assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
            assert set(said.split(",")) - {""} <= set(r.spans.split(","))

    check(secrets.findings(clashing(frame(spark, SECRETS))).collect(), SECRETS)
    check(queries.op6_secret_ledger(spark, SF).collect(), dict(documents(spark)))
    assert secrets.findings(frame(spark, [])).count() == 0


def test_secrets_ledger_is_incremental(spark, tmp_path, monkeypatch):
    first, more = frame(spark, SECRETS[:8]), clashing(frame(spark, SECRETS))
    path = str(tmp_path / "ledger")
    distinct = lambda texts: {t or "" for t in texts}
    assert secrets.scan_into(first, path).count() == len(distinct(SECRETS[:8]))
    pairs = secrets.unseen(more, secrets.ledger_at(more, path)).collect()
    assert {r.text for r in pairs} == distinct(SECRETS) - distinct(SECRETS[:8]) and all(r.rules == secrets.present() for r in pairs)
    key = lambda df: sorted((str(r.doc_id), r.spans, r.base_sha256) for r in df.collect())
    assert key(secrets.findings(more, path)) == key(secrets.findings(more))
    assert secrets.unseen(more, secrets.ledger_at(more, path)).count() == 0  # nothing is scanned twice
    # a new version of one rule: that rule alone runs again, over all blobs, and only its new findings count
    rules = secrets.RULES | {"hex": "2"}
    again = secrets.unseen(more, secrets.ledger_at(more, path), rules).collect()
    assert {r.text for r in again} == distinct(SECRETS) and {tuple(r.rules) for r in again} == {("hex@2",)}
    assert key(secrets.findings(more, path, rules)) == key(secrets.findings(more))


def test_secrets_are_scanned_where_texts_lie(spark, tmp_path):
    """A new ledger moves blobs and findings, not texts; its rows are one a blob, though copies stand in many tasks."""
    rng = np.random.default_rng(6)
    texts = ["token = abcdef1 " + rng.bytes(250_000).hex() for _ in range(12)]
    frame(spark, texts * 2 + SECRETS).repartition(9).write.parquet(str(tmp_path / "docs"))
    docs, sc = spark.read.parquet(str(tmp_path / "docs")), spark.sparkContext

    def moved():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    ledger = secrets.scan_into(docs, str(tmp_path / "ledger"))
    assert sum(n for k, n in moved().items() if k not in before) < 200_000  # the texts are 6 MB
    assert ledger.count() == ledger.select("blob").distinct().count() == len({t or "" for t in texts + SECRETS})
    out = {r.doc_id: r for r in secrets.findings(docs, str(tmp_path / "ledger")).collect()}
    for i, t in enumerate(texts * 2 + SECRETS):
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t or "")).encode()).hexdigest()


def test_a_task_scans_copies_once(monkeypatch):
    batch = lambda texts: secrets.pa.RecordBatch.from_pydict({"blob": [hashlib.sha256(t.encode()).digest() for t in texts], "text": texts, "rules": [["hex@1", "access@1"]] * len(texts)})
    batches = [batch(["f" * 24, "a", "f" * 24]), batch(["a", "a"]), batch(["b", "f" * 24, "AKIA" + "A" * 16])]
    scanned = lambda: [(r["blob"], [h["rule"] for h in r["hits"]]) for b in secrets._scan(iter(batches)) for r in b.to_pylist()]
    key = lambda t: hashlib.sha256(t.encode()).digest()
    want = [(key("f" * 24), ["hex@1"]), (key("a"), []), (key("b"), []), (key("AKIA" + "A" * 16), ["access@1"])]
    assert scanned() == want
    monkeypatch.setattr(secrets, "MOST_BLOBS", 2)  # what is forgotten is scanned again, nothing is left out
    again = scanned()
    assert len(again) > 4 and all(x in want for x in again) and all(x in again for x in want)


def test_secrets_of_all_versions(spark, tmp_path):
    rows = [(1, 1, "token = abcdef1"), (1, 2, "nothing"), (2, 1, "token = abcdef1"), (None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, v int, text string")
    out = {(r.doc_id, r.version): r.n_assign for r in secrets.findings(docs, version="v").collect()}
    assert out == {(1, 1): 1, (1, 2): 0, (2, 1): 1, (None, 1): 0}
    assert secrets.versions(docs, "v").select("blob").distinct().count() == 3


# 8


def wordings():
    """(words, identifier) of each known sentence; a sentence of several licences is the first one's."""
    split = lambda said: tuple(re.findall(r"[^\W_]+", said.lower()))
    out = {}
    for name, said in licenses.LICENCES.items():
        for k, x in enumerate(said, 1):
            out.setdefault(split(x), f"{name.lower()}-{k}")
    for k, (_, x) in enumerate(licenses.NOTICES, 1):
        out.setdefault(split(x), f"notice-{k}")
    for name, k, x in licenses.FORMS:
        out.setdefault(split(x), out[split(licenses.LICENCES[name][k - 1])])
    return out


def brute_sentences(text, known):
    """Identifiers of known sentences, word by word: a sentence begins and ends at a line or sentence end and goes over no blank line."""
    at = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]
    said = [w for _, _, w in at]
    between = [text[a[1] : b[0]] for a, b in zip(at[:-1], at[1:], strict=True)]
    edge = [True, *[bool(re.search(r"\n|[.!?:]\s", x)) for x in between], True]
    blank = [x.count("\n") > 1 for x in between]
    by_first, out, i = {}, [], 0
    for w in known:
        by_first.setdefault(w[0], []).append(w)
    while i < len(said):
        fits = [w for w in by_first.get(said[i], ()) if edge[i] and tuple(said[i : i + len(w)]) == w and edge[i + len(w)] and not any(blank[i : i + len(w) - 1])]
        if fits:
            best = max(fits, key=len)
            out.append(known[best])
            i += len(best)
        else:
            i += 1
    return out


def test_licenses(spark):
    mit, notice = licenses.LICENCES["MIT"], dict((y, x) for x, y in licenses.NOTICES)
    said = {v: k for k, v in notice.items()}
    texts = [
        None, "", "nothing here", "Intro. Released under the MIT License. More.", "\n".join([mit[0], "x.", *mit[1:]]),
        f"{said['Apache-2.0']}\n{said['CC-BY-NC-4.0']}", "\n".join([mit[0], "a.", "b.", "c.", mit[1]]), said["GPL-3.0"].upper().replace(" ", "   "), f"{said['MIT']} {said['MIT']}", "x " * 50000 + "\n" + said["Apache-2.0"],
    ]
    out = {r.doc_id: r for r in licenses.scan(clashing(frame(spark, texts))).collect()}
    assert [out[i].licenses for i in range(len(texts))] == [[], [], [], ["MIT"], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], ["MIT"], ["GPL-3.0"], ["MIT", "MIT"], ["Apache-2.0"]]
    assert out[4].matches == "MIT:0:4" and out[6].n_known == 2
    assert licenses.scan(frame(spark, [])).count() == 0


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.""",
    "Apache-2.0": """Copyright 2020 A. Nobody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301 USA.""",
    "BSD-3-Clause": """Copyright (c) 2020, A. Nobody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
WRAPPED["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n\n", "", WRAPPED["BSD-3-Clause"], flags=re.S)


def test_licenses_wrapped(spark):
    marks = ["{}", " * {}", "# {}", "// {}", "REM {}", "{}\r"]
    texts = [(name, "int x\n" + "\n".join(m.format(line).rstrip(" ") for line in t.split("\n"))) for name, t in WRAPPED.items() for m in marks]
    for (name, _), x in zip(texts, sorted(licenses.scan(clashing(frame(spark, [t for _, t in texts]))).collect(), key=lambda x: x.doc_id), strict=True):
        assert x.licenses == [name], (name, x)


def test_every_licence_and_form_is_named():
    r = licenses.Recogniser()
    name = lambda text: [m[0] for m in r.match(r.recognise(text))]
    for licence, said in licenses.LICENCES.items():
        assert name("\n".join(said)) == [licence] == name("All rights reserved.\n\n" + "\n\n".join(said))
    known = wordings()
    for licence, k, said in licenses.FORMS:
        assert [x for _, x in r.recognise(said)] == brute_sentences(said, known) and len(r.recognise(said)) == 1
    for licence, said in licenses.NOTICES:
        assert name(said) == [licence]
    assert name(licenses.LICENCES["BSD-2-Clause"][0]) == ["BSD"] and r.recognise(WRAPPED["BSD-2-Clause"].replace("without\nmod", "without\n\nmod"))[0][1] == "notice-7"


def test_licenses_against_words(spark):
    known, r = wordings(), licenses.Recogniser()
    texts = [*WRAPPED.values(), *["\n".join(x) for x in licenses.LICENCES.values()], *[" ".join(x) for x in licenses.LICENCES.values()], *[t or "" for t in invented()]]
    for t in texts:
        assert [i for _, i in r.recognise(t)] == brute_sentences(t, known)
    out = {x.doc_id: x for x in queries.op8_license_sentences(spark, SF).collect()}
    for d, text in documents(spark):
        assert out[d].sentence_ids == brute_sentences(text or "", known)
    assert sum(bool(x.licenses) for x in out.values()) > 0


# 10

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def brute_hits(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item_id, said in items:
        w = words_of(said)
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1) if k else ():
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add("null" if item_id is None else str(item_id))
    return words, hit, sorted(found)


def check_marks(out, texts, items):
    assert len(out) == len(texts)
    for r in out:
        words, hit, found = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(words), len(hit), len(found), decontaminate.digest(found))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def benchmark_fixture():
    texts = invented()
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, None), (2, ""), (10, long), (3, "Short Item"), (4, texts[20]), (4, long), (5, "日本語"), (None, texts[25]), (6, " ".join(f"v{i}" for i in range(300)))]
    texts += ["v100 " * 3 + " ".join(f"v{i}" for i in range(20, 260)), long.upper(), "a short, ITEM b", "w3 " + long + " tail " * 900, "w0 w1 w2", "short\n" * 30, " ".join(f"w{i}" for i in range(12)), "x 日本語 y"]
    return texts, items


def test_decontamination(spark):
    texts, items = benchmark_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    check_marks(decontaminate.report(clashing(frame(spark, texts)), bench).collect(), texts, items)
    assert decontaminate.report(frame(spark, []), bench).count() == 0
    none = decontaminate.report(frame(spark, texts), bench.limit(0)).collect()
    assert not any(r.contaminated for r in none)


def test_decontamination_in_parts_and_removal(spark, monkeypatch):
    texts, items = benchmark_fixture()
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    monkeypatch.setattr(decontaminate.window_sets, "__defaults__", (13, 140))
    check_marks(decontaminate.report(frame(spark, texts), bench).collect(), texts, items)
    out = {r.doc_id: r.text for r in decontaminate.remove(clashing(frame(spark, texts)), bench).collect()}
    for i, t in enumerate(texts):
        words, hit, _ = brute_hits(t, items)
        if hit and 20 * len(hit) >= len(words):
            assert i not in out
        elif not hit:
            assert out[i] == t
        else:
            assert words_of(out[i]) == [w for k, w in enumerate(words) if k not in hit]


def test_long_items_are_cut_into_pieces_with_all_windows():
    text = " ".join(f"w{i}" for i in range(500))
    cut = list(decontaminate.pieces(text, 100))
    windows = lambda t: {tuple(words_of(t)[i : i + 13]) for i in range(len(words_of(t)) - 12)}
    assert len(cut) > 10 and max(map(len, cut)) < 200 and set().union(*map(windows, cut)) == windows(text)


def test_removal_unites_parts(spark, monkeypatch):
    said = [" ".join(f"{c}{i}" for i in range(26)) for c in "pq"]
    over = [f"z{i}" for i in range(20)]
    items = [(1, said[0]), (2, said[1]), (3, " ".join(over[:14])), (4, " ".join(over[5:]))]
    fill = lambda n: " ".join(f"f{i}" for i in range(n))
    texts = [f"{said[0]} {fill(948)} {said[1]}", f"{said[0]} {fill(974)}", f"{' '.join(over)} {fill(980)}", "clean", None, f"{fill(980)}, {' '.join(over)}."]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    cut = lambda: {r.doc_id: r.text for r in decontaminate.remove(clashing(frame(spark, texts)), bench).collect()}
    whole = cut()
    monkeypatch.setattr(decontaminate.window_sets, "__defaults__", (13, 140))
    assert len(list(decontaminate.window_sets(bench))) > 2
    assert cut() == whole and set(whole) == {1, 2, 3, 4, 5}
    assert whole[1].split() == whole[2].split()[:974] and words_of(whole[2]) == words_of(whole[5]) == words_of(fill(980))


def test_decontamination_on_small_tables(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = queries.op10_benchmark_decontamination(spark, SF).collect()
    check_marks(out, dict(documents(spark)), items)
    assert any(r.contaminated for r in out)


def test_hash_of_runs_depends_on_bytes_alone():
    codes = np.frombuffer(b"abc xyz abc abcd", np.uint8)
    h = kernels.run_hashes(codes, np.array([0, 4, 8, 12]), np.array([3, 3, 3, 4]))
    assert h[0] == h[2] and len(set(h.tolist())) == 3
