import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from framewise.llm import alignment, perfect_hash
from framewise.llm.queries import QUERIES, vocabulary
from tests.conftest import SF
from tests.llm.helpers import AWKWARD, DOCS, docs, prose

PIECES = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


LETTERS = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if chr(b) not in LETTERS)}


def tokens(tokenizers, text):
    """(id, bytes) of both, token by token."""
    a, b = tokenizers
    if not text:
        return [], []
    entry = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(entry.ids, entry.tokens, strict=True)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])


def by_hand(tokenizers, texts):
    """One tuple per text."""
    parts, corpus = [], collections.Counter()
    for text in texts:
        left, right = tokens(tokenizers, text)
        ends = []
        for side in (left, right):
            at, found = 0, {}
            for n, (i, raw) in enumerate(side):
                at += len(raw)
                found[at] = (n, i)
            ends.append(found)
        links, groups, done_a, done_b = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            (n, i), (m, j) = ends[0][at], ends[1][at]
            links.append((i, j))
            groups.append(",".join(str(x) for x, _ in left[done_a : n + 1]) + "|" + ",".join(str(x) for x, _ in right[done_b : m + 1]))
            done_a, done_b = n + 1, m + 1
        corpus.update(links)
        parts.append((len(left), len(right), links, groups))
    top = collections.defaultdict(int)
    for (_, j), n in corpus.items():
        top[j] = max(top[j], n)
    return [
        (a, b, len(groups), len(links), sum(corpus[x] == top[x[1]] for x in links), sum(corpus[x] for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for a, b, links, groups in parts
    ]


def rows_of(df):
    return sorted((tuple(-1 if v is None else v for v in r) for r in df.collect()), key=repr)


def wanted(tokenizers, rows):
    return sorted(((-1 if i is None else i, *x) for (i, *_), x in zip(rows, by_hand(tokenizers, [r[1] for r in rows]), strict=True)), key=repr)


ODD = [
    "plain words of a text", "  two  spaces ", "\ttab\nline\r\n", "naïve café 東京 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under▁score", "ﬁ ligature Å",
    "\x00\x01", "don't we'll 1234567 ... !!", "á combining", " no-break", "x" * 5000, " ", "\n", "The the THE",
]


def test_odd_texts(spark, scratch, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    monkeypatch.setattr(alignment, "LANE_CHUNKS", 2)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 5)
    rows = [(n, t, "s") for n, t in enumerate(ODD * 2)]
    assert rows_of(alignment.align(docs(spark, rows), scratch, vocabulary(), PIECES)) == wanted(tokenizers, rows)


def test_awkward_rows(spark, scratch, tokenizers):
    table = docs(spark, AWKWARD, extra=True)
    assert rows_of(alignment.align(table, scratch, vocabulary(), PIECES)) == wanted(tokenizers, AWKWARD)
    empty = alignment.align(spark.createDataFrame([], DOCS), scratch, vocabulary(), PIECES)
    assert empty.count() == 0 and empty.columns == list(alignment.ALIGNED)
    nothing = alignment.align(docs(spark, [(1, None, "a"), (2, "", "b")]), scratch, vocabulary(), PIECES)
    assert rows_of(nothing) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_third_of_the_rows_are_copies(spark, scratch, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(alignment, "LANE_CHUNKS", 3)
    rows = [(n, "the same text again and again" if n % 3 else prose(n, 30), "s") for n in range(300)]
    assert rows_of(alignment.align(docs(spark, rows), scratch, vocabulary(), PIECES)) == wanted(tokenizers, rows)


def test_query_against_plain_alignment(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_tokenizer_alignment"](spark, SF)) == wanted(tokenizers, rows)


@pytest.mark.parametrize("size", [0, 1, 2, 7, 100, 4096])
def test_hash_is_minimal_and_perfect(size):
    r = random.Random(size)
    keys = np.array(r.sample(range(1 << 48), size), np.int64)
    levels = perfect_hash.build(keys)
    assert sorted(perfect_hash.index(keys, levels)) == list(range(size))
    assert sum(map(len, levels)) * 8 <= 6 * size + 32
    others = np.array(r.sample(range(1 << 50, 1 << 52), 50), np.int64)
    assert all(-1 <= x < max(size, 1) for x in perfect_hash.index(others, levels))


def test_pairs_that_were_not_numbered_are_an_error():
    keys = np.arange(10, dtype=np.int64)
    with pytest.raises(ValueError):
        alignment._verified(np.array([77], np.int64), perfect_hash.build(keys), keys)
