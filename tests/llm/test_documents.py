"""Fingerprints, media, licenses, line dedup, near-duplicates, toxicity and the pipeline."""

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import fingerprint as fp
from sparkloom.llm import license_texts, licenses, line_dedup, media, neardup, queries, toxicity

from .brute import levenshtein_like, near_groups
from .test_tokens import check_packing

WORDS = "the of and to in a is it was for on are as with they be at this have from or one had by word but not what all were we when".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


def docs_frame(spark, texts, parts=3):
    schema = "id long, body string, doc_id string, text string, node int, _gone int, _text_key int, _kept_id int"
    return spark.createDataFrame([(k, t, "d", "t", 0, 1, 2, 3) for k, t in texts], schema).repartition(parts, "id")


# ---- fingerprints


def test_fingerprint_equal_local_and_whole():
    text = prose(1, 3000)
    assert fp.fingerprint(text) == fp.fingerprint(text) and fp.likeness(fp.fingerprint(text), fp.fingerprint(text)) == 1.0
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:9000] + "CHANGED" + text[9010:])) > 0.9
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(prose(2, 3000))) < 0.1
    assert fp.fingerprint(text) != fp.fingerprint(text + "!") and fp.fingerprint("") == "3::"
    assert fp.likeness("3::", "3::") == 1.0 and fp.likeness("3::", fp.fingerprint("abc")) == 0.0


def test_rolling_hash_and_blocks(monkeypatch):
    raw = np.frombuffer(prose(3, 300).encode(), np.uint8)
    whole = np.concatenate([h for _, h in fp._rolling(raw)])
    for i in (0, 3, 50, len(raw) - 1):  # by the definition, byte by byte
        total, mixed = 1, 0
        for j in range(fp.WINDOW):
            if i - j >= 0:
                total += int(raw[i - j]) * (fp.WINDOW + 1 - j)
                mixed ^= (int(raw[i - j]) << 5 * j) & 0xFFFFFFFF
        assert int(whole[i]) == (total + mixed) & 0xFFFFFFFF
    one = fp.fingerprint(prose(3, 300))
    monkeypatch.setattr(fp, "_STEP", 97)
    assert fp.fingerprint(prose(3, 300)) == one


def plain_fingerprint(text):
    """By the definition, byte by byte."""
    raw = text.encode()
    if not raw:
        return "3::"

    def roll(i):
        total, mixed = 1, 0
        for j in range(7):
            if i - j >= 0:
                total += raw[i - j] * (8 - j)
                mixed ^= (raw[i - j] << 5 * j) & 0xFFFFFFFF
        return (total + mixed) & 0xFFFFFFFF

    hashes, size = [roll(i) for i in range(len(raw))], 3
    while size * 64 < len(raw):
        size *= 2
    while size > 3 and sum(h % size == 0 for h in hashes) < 32:
        size //= 2

    def letters(size):
        out, chunk = "", b""
        for i, h in enumerate(hashes):
            chunk += raw[i : i + 1]
            if h % size == 0 and len(out) < 63:
                out, chunk = out + fp.ALPHABET[zlib.crc32(chunk) % 64], b""
        return out + (fp.ALPHABET[zlib.crc32(chunk) % 64] if chunk else "")

    return f"{size}:{letters(size)}:{letters(2 * size)}"


@pytest.mark.parametrize("text", ["", "a", "é😀", "x" * 5000, "ab" * 3000, prose(1, 40), prose(2, 700), "\n".join(prose(k, 30) for k in range(40)), "q" * 900 + prose(3, 60)])
def test_fingerprint_equals_plain_version(text):
    assert fp.fingerprint(text) == plain_fingerprint(text)


def test_common_subsequence_is_an_edit_distance():
    r = random.Random(5)
    for _ in range(60):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(4, 40))) for _ in "ab")
        assert 2 * fp._common(a, b) / (len(a) + len(b)) == pytest.approx(levenshtein_like(a, b))


def test_edit_sensitivity(spark):
    texts = [(5, prose(1, 200)), (9, None), (2, ""), (7, "é" * 41), (1, prose(2, 900)), (3, prose(1, 200)), (4, "x"), (8, prose(4, 20000))]
    got = {r["doc_id"]: r for r in fp.edit_sensitivity(docs_frame(spark, texts), "id", "body").collect()}
    order = sorted(texts, reverse=True)
    assert set(got) == {k for k, _ in texts}
    for (k, t), (_, other) in zip(order, order[1:] + order[:1]):
        t, other = t or "", other or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.fingerprint(t), fp.fingerprint(edited))
        assert r["near_edited"] == fp.likeness(fp.fingerprint(t), fp.fingerprint(edited)) and r["near_next"] == fp.likeness(fp.fingerprint(t), fp.fingerprint(other))
    assert fp.edit_sensitivity(docs_frame(spark, texts).limit(0), "id", "body").count() == 0
    assert fp.edit_sensitivity(docs_frame(spark, texts[:1] * 3), "id", "body").count() == 3
    assert fp.edit_sensitivity(docs_frame(spark, [(None, "a"), (None, "b"), (1, "c")]), "id", "body").count() == 3
    assert fp.fingerprints(docs_frame(spark, texts), "id", "body").count() == len(texts)


# ---- media


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\1\2" * 2)) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\x00\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\x00\x08\1\1\0\0\x3f\0" + b"\x12\xff\x00\x34" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
OGG = b"OggS\0\6" + b"\0" * 20 + b"\1\3abc"
MP4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s", 12, b"mdat") + b"data"
FLAC = b"fLaC\x80\0\0\x22" + b"\0" * 34 + b"\xff\xf8abc"
SAMPLES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": gzip.compress(b"hello" * 50), "application/zip": archive(), "audio/wav": media.to_wav(b"abc"), "audio/ogg": OGG, "video/mp4": MP4, "audio/flac": FLAC}


@pytest.mark.parametrize("kind", sorted(SAMPLES))
def test_each_format_is_confirmed_or_refused(kind):
    data = SAMPLES[kind]
    assert media.sniff(data) == [(0, len(data), kind)]
    assert media.true_type(data, "text/plain") == kind
    if kind != "audio/flac":  # has no length of its own
        assert media.sniff(b"..junk.." + data + b"tail") == [(8, len(data), kind)]
    for cut in range(len(data) if kind != "audio/flac" else 40):
        assert all(t != kind for _, _, t in media.sniff(data[:cut])) or kind == "video/mp4"


def test_hostile_data_takes_linear_time():
    import time

    for part, size in ((b"%PDF-1.4 startxref ", 1 << 20), (b"PK\3\4 PK\5\6" + b"\0" * 9, 1 << 20), (b"%PDF-1.4 %%EOF ", 1 << 20), (b"BMRIFFOggSftyp", 1 << 20)):
        began = time.process_time()
        assert media.sniff(part * (size // len(part))) == []
        assert time.process_time() - began < 5
    two = PDF + b"\n" + PDF + b"\nstartxref\n1\n%%EOF"
    assert [(a, n) for a, n, _ in media.sniff(two)] == [(0, len(PDF)), (len(PDF) + 1, len(two) - len(PDF) - 1)]
    assert [t for *_, t in media.sniff(b"PK\5\6" + archive() + archive())] == ["application/zip"] * 2


def test_sniff_media(spark):
    rows = [(1, png(), "image/jpeg"), (2, b"plain", "text/plain"), (3, None, None), (4, b"head" + GIF + PDF, "image/png"), (5, b"", "audio/wav")]
    got = {r["id"]: r for r in media.sniff_media(spark.createDataFrame(rows, "k long, d binary, t string"), "k", "d", "t").collect()}
    assert [got[k]["media_type"] for k in range(1, 6)] == ["image/png", "text/plain", "application/octet-stream", "application/octet-stream", "application/octet-stream"]
    assert [got[k]["corrected"] for k in range(1, 6)] == [True, False, False, True, True]
    assert [(o["offset"], o["media_type"], bytes(o["data"])) for o in got[4]["objects"]] == [(4, "image/gif", GIF), (4 + len(GIF), "application/pdf", PDF)]


def test_store_payloads(spark):
    texts = [(1, None), (2, ""), (3, "x" * 64), (4, "é😀"), (5, "RIFF and " + "y" * 70000), (5, "RIFF and " + "y" * 70000)]
    got = [(r["doc_id"], r) for r in media.store_payloads(docs_frame(spark, texts), "id", "body").collect()]
    assert len(got) == 6
    for k, r in got:
        raw = (dict(texts)[k] or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        wav = media.to_wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(wav), hashlib.sha256(wav).hexdigest()) and f"samples={len(payload)};" in r["feature"]
    assert len({r["feature"] for k, r in got if k in (1, 2)}) == 1
    assert media.store_payloads(docs_frame(spark, texts).limit(0), "id", "body").count() == 0


# ---- licenses


def test_license_scan(spark):
    t = license_texts.TEMPLATES
    changed = t["MIT"].replace("free of charge", "at no cost").replace("deal in", "work with")
    texts = [(1, prose(1, 50) + "\n" + t["MIT"] + "\n" + prose(2, 50)), (2, changed), (3, prose(3, 500)), (4, None), (5, ""), (6, "Released under the MIT License."), (7, t["BSD-3-Clause"] + " " + t["ISC"]), (8, "the of and " * 20000)]
    got: dict = {}
    for r in licenses.scan_licenses(docs_frame(spark, texts), "id", "body", t).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k: sorted(m["license"] for m in v) for k, v in got.items()} == {1: ["MIT"], 2: ["MIT"], 6: ["MIT/notice"], 7: ["BSD-3-Clause", "ISC"]}
    assert got[1][0]["coverage"] == 1.0 and 0.9 < got[2][0]["coverage"] < 1.0
    body = dict(texts)[1]
    assert body[got[1][0]["start"] : got[1][0]["end"]] == t["MIT"].rstrip(".")
    assert licenses.scan_licenses(docs_frame(spark, texts).limit(0), "id", "body", t).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(12))
def test_edited_licenses_equal_brute_force_alignment(seed):
    """Words changed, left out or put in: matched words are those of the whole alignment table, and the span is the edited text."""
    r = random.Random(seed)
    name = r.choice([n for n, t in license_texts.TEMPLATES.items() if len(t.split()) > 60])
    want = licenses._WORD.findall(license_texts.TEMPLATES[name].lower())
    edited = []
    for k, w in enumerate(want):
        x = r.random() if 3 < k < len(want) - 4 else 1
        edited += [] if x < 0.02 else [words(f"{seed} {k}", 1)] if x < 0.05 else [w, words(f"{seed} {k} more", 1)] if x < 0.06 else [w]
    text = f"{words(seed, 40)} {' '.join(edited)} {words(-seed - 1, 40)}"
    found = licenses.LicenseIndex(license_texts.TEMPLATES).scan(text)
    matched = longest_common(want, text.split())
    assert matched >= licenses.COVERAGE * len(want)
    # of versions that share most of their words the one with most matched words is told
    every = {n: longest_common(ws, text.split()) for n, t in license_texts.TEMPLATES.items() if (ws := licenses._WORD.findall(t.lower()))}
    assert [(m.matched, every[m.name]) for m in found] == [(max(every.values()),) * 2]
    if found[0].name == name:
        assert text[found[0].start : found[0].end] == " ".join(edited)


def test_every_template_finds_itself():
    scan = licenses.LicenseIndex(license_texts.TEMPLATES).scan
    for name, text in license_texts.TEMPLATES.items():
        found = scan(prose(7, 30) + " " + text + " " + prose(8, 30))
        assert [m.coverage for m in found if m.name == name] == [1.0], name


def test_notices_that_recur_at_small_distance():
    scan = licenses.LicenseIndex(license_texts.TEMPLATES).scan
    notice = "Released under the MIT License"
    for count, between in ((3, ". bar 2.1 "), (40, " "), (3000, "; foo 1.0 ")):
        text = "foo 1.0 " + between.join([notice] * count) + "."
        starts = [8 + k * len(notice + between) for k in range(count)]
        assert [(m.name, m.start, m.end) for m in scan(text)] == [("MIT/notice", s, s + len(notice)) for s in starts]
    # a notice of lower coverage beside whole ones
    text = f"{notice}. Released under the old MIT License. {notice}. Released under a MIT License. {notice}."
    assert [m.matched for m in scan(text)] == [5, 5, 5, 4, 5]


# ---- line dedup


def lines_fixture():
    out = []
    for k in range(14):
        out.append((k, f"{prose(k, 12)}\nShared footer line of this site\nUser {k * 7} logged in from host{k}\n\n{prose(100 + k, 9)}\t "))
    names = "ann bob cid dan eve fay gus hal ida jon kim leo".split()
    out += [(50 + k, f"A reply by {n} in the general forum today\n{prose(500 + k, 8)}") for k, n in enumerate(names)]
    out += [(80 + k, prose(900, 30) + "\n" + prose(901, 30)) for k in range(12)]  # exact copies
    out += [(100, None), (101, ""), (102, "\n\n"), (103, "ok"), (104, "Shared footer line of this site"), (104, "Shared footer line of this site"), (105, "Shared  footer\tline of this site \r\nmore text is here")]
    return out


def kept_texts(spark, texts):
    return {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs_frame(spark, texts), "id", "body").collect()}


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def sql_rows(texts, min_texts=10):
    import pandas as pd

    con = duckdb.connect()
    con.register("docs_in", pd.DataFrame({"doc_id": pd.array([i for i, _ in texts], "Int64"), "text": pd.array([t for _, t in texts], "string")}))
    return sorted(map(repr, con.execute(line_dedup.oracle("docs_in", min_texts)).fetchall()))


def names(n):
    return [words(f"name {k}", 1) for k in range(n)]


def forms_fixture():
    """Templates of one length that share a leaf, and those with variable words among the leading ones."""
    forms = ["the job queue worker {} has started again", "the job queue gives {} up for now", "the job queue is {} and will close", "dear {} your order ships by monday noon", "{} wrote at noon and left a note", "{} {} {} went to see the old town hall by noon on foot"]
    out = [(100 * f + k, f"{words(f'{f} {k}', 5)}\n{form.format(n, n + 'a', n + 'b')}") for f, form in enumerate(forms) for k, n in enumerate(names(16))]
    # unrelated lines that begin alike, and lines like a template that are too few
    out += [(5000 + k, f"the job queue {words(f'noise {k}', 5)}") for k in range(40)]
    out += [(6000 + k, f"{words(f'few {k}', 5)}\nsix {n} of these words are fixed here") for k, n in enumerate(names(4))]
    return out


def test_line_dedup_equals_sql(spark):
    for texts in (lines_fixture(), [], [(None, "a b c d"), (None, "a b c d\nx y z w")] * 8, forms_fixture()):
        kept = line_dedup.dedup_lines(docs_frame(spark, texts), "id", "body", 10).collect()
        got = [(r["doc_id"], r["n_lines"], r["n_dropped"], None if r["kept_text"] is None else len(r["kept_text"]), None if r["kept_text"] is None else hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in kept]
        assert sorted(map(repr, got)) == sql_rows(texts)


def test_line_dedup_of_templates_in_one_leaf_and_variable_leading_words(spark):
    texts = forms_fixture()
    want = {i: t.split("\n")[0] if i < 5000 and i % 100 else t for i, t in texts}
    assert kept_texts(spark, texts) == want


def test_line_dedup_of_long_texts(spark):
    own = "\n".join(words(f"long {k}", 6) for k in range(20_000))
    texts = [(1, own), (2, own + "\nand one more line of it"), (3, "short")]
    assert kept_texts(spark, texts) == {1: own, 2: own + "\nand one more line of it", 3: "short"}  # two texts are too few for six words
    texts += [(10 + k, f"{own}\nthe {n} end") for k, n in enumerate(names(9))]
    got = kept_texts(spark, texts)
    assert got[1] == own and got[2] == "and one more line of it" and got[10].startswith("the ")


def test_line_dedup_generalises_and_keeps(spark):
    texts = lines_fixture()
    got: dict = {}
    for r in line_dedup.dedup_lines(docs_frame(spark, texts), "id", "body", 10).collect():
        got[r["doc_id"]] = r
    assert got[0]["n_dropped"] == 0 and got[1]["n_dropped"] == 2 and got[104]["kept_text"] == ""
    assert got[50]["n_dropped"] == 0 and all(got[50 + k]["n_dropped"] == 1 for k in range(1, 12))  # a name is a variable field
    assert all(got[80 + k]["n_dropped"] == 0 for k in range(12))  # copies of a whole text are no recurring lines
    cut = line_dedup.drop_recurring_lines(docs_frame(spark, texts), "id", "body", 10)
    assert cut.columns == docs_frame(spark, texts).columns
    left = {r["id"]: r for r in cut.collect()}
    assert 104 not in left and 100 in left and left[1]["_gone"] == 1 and left[1]["_text_key"] == 2
    assert "Python" not in cut._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_of_few_texts(spark):
    lengths = {3: 10, 7: 10, 8: 3, 19: 3, 20: 2, 60: 2}
    texts, want = [], {}
    for n, least in lengths.items():
        for times in (least - 1, least):
            for k in range(times):
                i, own = len(texts), words(f"{n} {times} {k}", 5)
                texts.append((i, f"{own}\n{words(f'{n} {times}', n)}"))
                want[i] = own if times == least and k else texts[-1][1]
    texts += [(900 + k, words("copy", 70) + "\n" + words("copies", 9)) for k in range(12)]  # exact copies are one text
    assert kept_texts(spark, texts) == want | dict(texts[-12:])


def test_line_dedup_of_several_templates(spark):
    names = "ann bob cid dan eve fay gus hal ida jon kim leo".split()
    forms = ["the user named {} left a short reply here", "the user named {} has reached another new level"]
    texts = [(100 * f + k, f"{words(f'{f} {k}', 5)}\n{form.format(n)}") for f, form in enumerate(forms) for k, n in enumerate(names)]
    want = {i: t if i % 100 == 0 else t.split("\n")[0] for i, t in texts}
    # unrelated lines that begin alike
    noise = [(1000 + k, f"the user named {words(f'noise {k}', len(forms[0].split()) - 3)}") for k in range(60)]
    assert kept_texts(spark, texts + noise) == want | dict(noise)


def test_line_dedup_of_stamps(spark):
    texts = [(k, f"{words(f'own {k}', 5)}\n2026-11-{k + 10} 10:0{k % 9}:02 {k} login\n[12:{k}] 10.0.0.{k} {k + 400} GET 17") for k in range(12)]
    texts += [(100 + k, f"{words(f'table {k}', 5)}\n{k} {k + 1} {k + 2} {k + 3}") for k in range(12)]  # nothing constant
    texts += [(200 + k, f"{words(f'row {k}', 5)}\n" + " ".join(str(k * j + j) for j in range(25)) + " km") for k in range(3)]
    want = {i: t.split("\n")[0] if 0 < i < 100 else t for i, t in texts}
    assert kept_texts(spark, texts) == want


def test_line_dedup_leaves_no_shuffle_files(spark):
    """What a materialised step has shuffled is deleted, not kept until the driver collects garbage."""
    import time

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(k).getName() for k in range(files.size())) if f.startswith("shuffle_")}

    old = shuffled()
    out = line_dedup.dedup_lines(docs_frame(spark, lines_fixture()), "id", "body")
    for _ in range(20):
        if not shuffled() - old:
            break
        time.sleep(0.25)
    assert not shuffled() - old
    assert out.count() == len(lines_fixture())


# ---- near-duplicates


def near_fixture():
    r, base, out = random.Random(5), [], []
    base = [r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(120)]
    for k in range(260):
        p = r.choice((0.002, 0.01, 0.02, 0.025, 0.03, 0.04))
        out.append((1000 + k, " ".join(r.choice(WORDS) + "x" if r.random() < p else w for w in base)))
    out += [(1, None), (2, ""), (3, " \n\t"), (4, " a "), (5, "A"), (6, "a b c d"), (7, "a B\tc d"), (8, "É x"), (9, "é x"), (10, "a b c d e"), (11, prose(1, 20000)), (12, prose(1, 19000)), (13, prose(1, 10000)), (14, "w " * 9000), (15, "w w w w w")]
    out += [(2000 + k, prose(4, 60)) for k in range(40)]
    return out


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_fixture()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs_frame(spark, texts), "id", "body").collect()}
    assert got == near_groups(texts)


def test_near_duplicates_edge_tables(spark):
    assert neardup.near_duplicates(docs_frame(spark, near_fixture()).limit(0), "id", "body").count() == 0
    rows = neardup.near_duplicates(docs_frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (3, "q")]), "id", "body").collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [(-1, -1, True), (-1, 7, False), (3, 3, True), (7, 7, True), (7, 7, True)]
    kept = neardup.drop_near_duplicates(docs_frame(spark, near_fixture()), "id", "body")
    assert kept.columns == docs_frame(spark, []).columns and kept.count() == sum(v[2] for v in near_groups(near_fixture()).values())


def test_near_dedup_keeps_one_row_of_each_group(spark):
    base = words("near", 60)
    near, far = base + " tail", words("far", 60)
    texts = [(7, base), (7, near), (7, base), (9, base), (None, base), (None, far), (None, far), (5, None), (5, None), (6, ""), (None, " ")]
    texts += [(3, far + " end"), (3, words("third", 60)), (None, words("fourth", 60)), (None, words("fourth", 60) + " tail")]
    kept = neardup.drop_near_duplicates(docs_frame(spark, texts), "id", "body")
    assert kept.columns == docs_frame(spark, []).columns
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    fourth = min(texts[-2][1], texts[-1][1], key=md5)
    want = [(7, min(base, near, key=md5)), (3, far + " end"), (3, words("third", 60)), (None, fourth), (5, None), (5, None), (6, ""), (None, " ")]
    assert sorted(map(repr, ((r["id"], r["body"]) for r in kept.collect()))) == sorted(map(repr, want))


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 127, 128, 5000):
        assert not (neardup.sketches([np.unique(rng.integers(1, 2**63, n).astype(np.uint64))]) == np.uint64(2**64 - 1)).any()
    seen = []
    for _ in range(60):
        x = rng.integers(1, 2**63, 175).astype(np.uint64)
        s = neardup.sketches([np.unique(x[:150]), np.unique(x[25:])])
        seen.append((s[0] == s[1]).mean())
    assert abs(np.mean(seen) - 125 / 175) < 0.02 and np.std(seen) < 0.06


def test_word_blocks(monkeypatch):
    text = prose(9, 500) + " " + "k" * 300
    one = neardup.shingle_sets([text, "", "a b"])
    monkeypatch.setattr(neardup, "_BLOCK", 64)
    assert all((a == b).all() for a, b in zip(one, neardup.shingle_sets([text, "", "a b"])))


def test_rare_shingles_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, neardup.SLOTS).astype(np.uint32)
    tried = 0
    while tried < 300:
        n = int(rng.integers(1, 60))
        x = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate((x[rng.random(len(x)) < 0.9], rng.integers(1, 2**63, int(rng.integers(0, 6))).astype(np.uint64))))
        if len(y) and neardup.similar(x, y):
            tried += 1
            small, large = sorted((x, y), key=len)
            short, low = neardup.rare_shingles(small, counts)
            assert set(short[:low].tolist()) & set(neardup.rare_shingles(large, counts)[0].tolist())


def test_near_duplicates_by_every_path(spark, monkeypatch):
    """With few members to a small bucket the index and the blocks decide as well."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    blocks, plain = [], neardup._cluster_links
    monkeypatch.setattr(neardup, "_cluster_links", lambda many, sets: blocks.append(1) or plain(many, sets))
    texts = near_fixture()
    for agree in (neardup.AGREE, 0):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs_frame(spark, texts), "id", "body", agree).collect()}
        assert got == near_groups(texts)
    assert blocks


def test_near_duplicates_of_a_template_grow_linearly(spark, monkeypatch):
    """Texts that share two thirds: their buckets chain to one cluster, in which nothing is linked and no pair is looked at."""
    r = random.Random(8)
    common = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(120))
    texts = [(k, common + " " + " ".join(f"{r.choice(WORDS)}{r.randint(0, 10**9)}" for _ in range(32))) for k in range(1500)]
    large, rows, plain = [], [], neardup._rare

    def watched(sets):
        found = plain(sets)
        large.append(sets.count())
        rows.append(found.groupBy("key").agg(F.count_if("low").alias("low"), F.count(F.lit(1)).alias("n")).where("low > 0").agg(F.sum("n"), F.max("n")).first())
        return found

    monkeypatch.setattr(neardup, "_rare", watched)
    monkeypatch.setattr(neardup, "_cluster_links", lambda many, sets: pytest.fail("compared in blocks"))
    got = neardup.near_duplicates(docs_frame(spark, texts), "id", "body").collect()
    assert sum(x["kept"] for x in got) == len(got) == 1500
    assert large[0] > 1000 and rows[0][0] <= 60 * large[0] and rows[0][1] < 10


def test_steps_of_components_write_few_files(spark):
    """A step over few links writes as many files as the cores ask for, not one for each shuffle partition."""
    from pathlib import Path

    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    links = spark.createDataFrame([(f"{k:03}".encode(), f"{k + 1:03}".encode()) for k in range(120)], "a binary, b binary").checkpoint()
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    old = set(folder.glob("rdd-*"))
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        got = neardup.components(links).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert {bytes(r["node"]) for r in got} == {f"{k:03}".encode() for k in range(1, 121)} and {bytes(r["root"]) for r in got} == {b"000"}
    steps = sorted(set(folder.glob("rdd-*")) - old, key=lambda d: int(d.name[4:]))[1:]  # the first holds the links as given
    assert steps and all(len(list(d.glob("part-*"))) <= 2 * spark.sparkContext.defaultParallelism for d in steps)


def test_block_links_are_exact():
    import pyarrow as pa

    texts = near_fixture()[:120]
    sets = neardup.shingle_sets([t for _, t in texts])
    nodes = [neardup._node(s) for s in sets]
    block = pa.table({"i": [0] * 120, "j": [0] * 120, "own": [0] * 120, "node": pa.array(nodes, pa.binary()), "root": pa.array(nodes, pa.binary()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    up = {n: n for n in nodes}
    for a, b in zip(*(c.to_pylist() for c in neardup._block_links(block).columns)):
        assert neardup.similar(sets[nodes.index(a)], sets[nodes.index(b)])
        old, new = up[a], up[b]
        up = {k: new if v == old else v for k, v in up.items()}
    want = near_groups(texts)
    assert len(set(up.values())) == sum(v[2] for v in want.values())


# ---- toxicity


def toxic_tables(spark):
    r, docs, labels = random.Random(8), [], []
    for k in range(400):
        words, toxic = [r.choice(WORDS) for _ in range(r.randint(40, 120))], k % 4 == 0
        if toxic:
            for _ in range(r.randint(2, 12)):
                words[r.randrange(len(words))] = r.choice(["grubbish", "vilest", "nastyen", "nastyung"])
        docs.append((k, " ".join(words), "de"))
        if k < 320:
            labels.append((k, 1, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (902, "grubbish vilest " * 3, "x"), (903, "the of " * 30000, "x"), (902, "grubbish vilest " * 3, "x")]
    labels += [(None, 1, 1), (5000, 1, 1), (0, 1, 1), (1, 0, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def toxic(spark):
    docs, labels = toxic_tables(spark)
    return docs, labels, toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic")


def test_toxicity_on_held_out_rows(spark, toxic):
    docs, _, model = toxic
    rows = toxicity.score(docs, "doc_id", "text", model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 405 and all(r["p_toxic"] >= r["p_severe"] >= r["p_extreme"] for r in rows)
    held = range(320, 400)
    assert sum(got[k]["toxic"] == (k % 4 == 0) for k in held) >= 78
    assert got[902]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"] and not got[903]["toxic"]
    graded = [got[k]["expected_severity"] for k in held if k % 4 == 0]
    density = [sum(w in ("grubbish", "vilest", "nastyen", "nastyung") for w in t.split()) / len(t.split()) for t in (r["text"] for r in docs.where("doc_id >= 320 and doc_id < 400 and doc_id % 4 = 0").orderBy("doc_id").collect())]
    assert np.corrcoef(graded, density)[0, 1] > 0.7
    assert list(model.thresholds) == sorted(model.thresholds)


def test_toxicity_edges(spark, toxic):
    docs, labels, model = toxic
    kept = toxicity.drop_toxic(docs, "text", model)
    assert kept.columns == docs.columns and {900, 901, 903} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id = 902").count() == 0
    assert toxicity.score(docs.limit(0), "doc_id", "text", model).count() == 0
    for some in (labels.limit(0), labels.where("toxic = 0")):
        none = toxicity.fit(docs, "doc_id", "text", some, "doc_id", "toxic")
        assert none.above("grubbish vilest")[0] < toxicity.TOXIC
    again = toxicity.fit(docs.repartition(7), "doc_id", "text", labels, "doc_id", "toxic")
    assert again == model
    twice = docs.union(docs.where("doc_id < 300").selectExpr("doc_id", "concat(text, ' grubbish')", "toxic"))  # other texts of known ids
    assert toxicity.fit(twice, "doc_id", "text", labels, "doc_id", "toxic") == toxicity.fit(twice.orderBy("text").repartition(5), "doc_id", "text", labels, "doc_id", "toxic")


# ---- queries and pipeline


def test_queries_return_their_contracts(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op4_near_dedup(spark, sf_dir).collect()}
    assert got == near_groups(list(docs.items()))
    assert {r["doc_id"] for r in queries.op3_fingerprint(spark, sf_dir).collect()} == set(docs)
    assert {r["doc_id"] for r in queries.op7_media(spark, sf_dir).collect()} == set(docs)
    assert {r["doc_id"] for r in queries.op5_toxicity(spark, sf_dir).collect()} == set(docs)
    assert {r["license"] for r in queries.op2_licenses(spark, sf_dir).collect()} <= set(license_texts.TEMPLATES)


def test_pipeline_equals_plain_version(spark, tmp_path):
    import pandas as pd

    import corpus_pipeline
    from sparkloom.llm.bpe import fast_encoder

    tox, labels = toxic_tables(spark)
    texts = [(10_000 + k, t) for k, t in lines_fixture()] + [(20_000 + k, t) for k, t in near_fixture()]
    texts = list(dict(texts).items()) + [(r["doc_id"], r["text"]) for r in tox.dropDuplicates(["doc_id"]).collect()]
    frame = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(frame, "doc_id", "text", labels, "doc_id", "toxic")
    clean = [(k, t) for k, t in texts if model.above(t or "")[0] < toxicity.TOXIC]
    assert 0 < len(texts) - len(clean) < 110
    con = duckdb.connect()
    con.register("docs_in", pd.DataFrame({"doc_id": [k for k, _ in clean], "text": pd.array([t for _, t in clean], "string")}))
    sql = line_dedup.oracle("docs_in").replace("sha256(coalesce(k.kept_text, d.text)) AS kept_sha256", "coalesce(k.kept_text, d.text) AS kept_text")
    cut = [(r[0], r[4]) for r in con.execute(sql).fetchall() if not (r[2] and not r[4].strip())]
    groups = near_groups(cut)
    want = {k: t or "" for k, t in cut if groups[k][2]}
    with open(queries.RANKS, "rb") as f:
        encode = fast_encoder(f.read(), queries.PATTERN).encode_ordinary
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), {k: [*encode(t), 1] for k, t in want.items()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id"} <= set(out.columns)
    (folder,) = {f.rsplit("/", 2)[0] for f in out.inputFiles()} or {None}
    assert folder is None or len(list(__import__("pathlib").Path(folder.removeprefix("file:").replace("//", "/")).iterdir())) == 1


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from sparkloom.llm.common import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[2,1,1024]")
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
