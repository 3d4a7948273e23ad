"""Encoding and decoding against the sentencepiece library; the character map against a plain longest match."""
import hashlib
import random
import struct

import pytest

from ledgerline.llm import pieces
from ledgerline.llm.common import prepare
from ledgerline.llm.queries import tokenizer_path

ODD = ["", " ", "  ", "\n", " \n ", "a", "▁", "▁▁ a ▁b", "a▁b  c\n\n d  ", "\0x", "日本語 text 😀😀 x", "<s> </s> <unk> <0x0A> <0x41>",
       "\t\ta\r\n", "a" * 5000, "  lead   and trail   ", "é́   x　y", "� x", "." * 100, "-----   ----"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def random_texts(n):
    rng = random.Random(20)
    chars = "  \n\tabcdeéß▁日😀.,-0123 　​"
    return ["".join(rng.choice(chars) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_codec_equals_library(library, monkeypatch):
    codec = pieces.Codec(tokenizer_path())
    for limit in (250_000, 3):  # the second starts its cache anew all the time
        monkeypatch.setattr(pieces, "CACHE_SEGMENTS", limit)
        for t in ODD + random_texts(300):
            ids, begin, end = codec.encode([t])[0]
            assert ids.tolist() == library.encode(t)
            assert codec.decode(ids.tolist()) == library.decode(library.encode(t))
            raw = t.encode()
            if raw:  # spans follow each other and cover the text
                assert begin[0] == 0 and end[-1] == len(raw) and (begin[1:] == end[:-1]).all()


def test_spans_name_the_source(library):
    codec = pieces.Codec(tokenizer_path())
    t = "The tion é 日\n x"
    ids, begin, end = codec.encode([t])[0]
    for i, b, e in zip(ids.tolist(), begin, end):
        surface = codec.surface[i].decode(errors="replace")
        if codec.kinds[i] == pieces.NORMAL:
            assert t.encode()[b:e].decode().strip(" ") == surface.strip(" ")


def double_array(entries: dict[bytes, bytes]) -> bytes:
    """A compiled character map with these entries."""
    targets, place = b"", {}
    for v in entries.values():
        if v not in place:
            place[v] = len(targets)
            targets += v + b"\0"
    trie: dict = {}
    for k, v in entries.items():
        node = trie
        for b in k:
            node = node.setdefault(b, {})
        node[-1] = place[v]
    units, used = [0] * 4096, {0}

    def lay(node, pos):
        labels = sorted(0 if b == -1 else b for b in node)
        base = next(o for o in range(1, 4096) if all((pos ^ o ^ b) < 4096 and (pos ^ o ^ b) not in used for b in labels))
        units[pos] |= base << 10
        if -1 in node:
            units[pos] |= 1 << 8
            units[pos ^ base] = node[-1] | 1 << 31
            used.add(pos ^ base)
        for b in labels:
            if b:
                used.add(pos ^ base ^ b)
        for b, child in node.items():
            if b != -1:
                units[pos ^ base ^ b] |= b
                lay(child, pos ^ base ^ b)

    lay(trie, 0)
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + targets


def test_longest_prefix_and_alignment():
    table = {"ﬁ": "fi", "Ａ": "A", "á": "á", "a": "b", "abc": "X", "　": " ", "…": "...", "\t": " "}
    blob = double_array({k.encode(): v.encode() for k, v in table.items()})
    norm = pieces.Normalizer(blob, True, True, True)
    for text, want in (("ﬁx Ａ", "▁fix▁A"), ("abcab á", "▁Xbb▁á"), ("  　 q…\t ", "▁q..."), ("", ""), (" \t", "")):
        out, align = norm(text)
        assert out.decode() == want
        assert len(align) == len(out) + 1 and align == sorted(align)
    out, align = norm("x ﬁ")  # the two letters of the ligature come from its first byte
    assert out == "▁x▁fi".encode() and align[-3:] == [2, 2, 5]
    plain = pieces.Normalizer(b"", True, False, True)
    assert plain(" a")[0].decode() == "▁▁a" and plain.plain and not norm.plain


def test_documents(spark, library):
    prepare(spark)
    texts = ODD + random_texts(50) + [None, "long word " * 20000]
    df = spark.createDataFrame([(i % 60, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    full = pieces.encode_decode(df, tokenizer_path(), rows=7).collect()
    for r in full:
        assert r["_pieces"].ids == library.encode(r.text or "")
        assert r["_pieces"].decoded == library.decode(library.encode(r.text or ""))
    got = pieces.digests(pieces.encode_decode(df, tokenizer_path()), "doc_id", "text").collect()
    for r in got:
        ids = library.encode(r.text or "")
        assert r.n_tokens == len(ids) and r.covered_bytes == len((r.text or "").encode())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode_decode(df.limit(0), tokenizer_path()).count() == 0
