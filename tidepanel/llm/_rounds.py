"""Questions that blocks of documents ask of buckets of hashes.

Documents are dealt into blocks by id; their number follows from the bytes of all texts, so a task holds about
``BLOCK_BYTES`` of them at any size of the corpus.  A block sends each bucket one message with what it wants to know about the
hashes that fall there (each distinct value once, so a frequent value costs a bucket one entry a block); the bucket
answers each block in the order asked.  A task takes ``TASK_BYTES`` on average at any size of the corpus, or less where
``spark.sql.shuffle.partitions`` asks for more tasks.  Blocks work deterministically on rows sorted by ``ord``, so a lost task that
is run again asks the same question.  Texts are shuffled once: all rounds read the same exchange.

Messages are rows ``(hash, block)`` packed by block and bucket.  A block never sends more messages than it has distinct
hashes, so their number is at most that of such rows, and their bytes grow with the corpus; what is packed together is
a matter of size only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm._shared import partitions, prime_at_least
from tidepanel.llm._text import tidy

MESSAGE = "bucket int, block int, payload binary"
#: Of text that a block holds, and whose hashes a bucket holds.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 32 << 20
#: Of text whose blocks or buckets one task takes, one after the other.
TASK_BYTES = 96 << 20
ANSWER = "block int, turn int, bucket int, payload binary"


class Rounds:
    """Two rounds over documents ``(ord, doc_id, text)``.

    ``one(pdf)`` and ``two(pdf, answers1)`` give (hashes to deal by, payload maker), see :func:`_messages`;
    ``answer1`` and ``answer2`` map a list of payloads to a list of answers (empty: nothing to say);
    ``last(pdf, answers1, answers2)`` gives the result.  ``pdf`` is sorted by ``ord``; answers map bucket -> payload.
    """

    def __init__(self, docs: DataFrame):
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(4, -(-size // BUCKET_BYTES))
        blocks = prime_at_least(max(7, -(-size // BLOCK_BYTES)))
        # Never fewer than the session's partitions: a cogroup then keeps this dealing and brings the answers to it.
        self.tasks = max(partitions(docs.sparkSession), -(-size // TASK_BYTES))
        self.docs = docs.withColumn("block", F.pmod("ord", F.lit(blocks)).cast("int")).repartition(self.tasks, "block")

    def run(self, one, answer1, two, answer2, last, schema: str) -> DataFrame:
        n = self.buckets

        def ask1(key, pdf):
            return tidied(_messages(key[0], n, one(_sorted(pdf))))

        def ask2(key, pdf, answers):
            return tidied(_messages(key[0], n, two(_sorted(pdf), _answers(answers, 1))))

        def end(key, pdf, answers):
            return tidied(last(_sorted(pdf), _answers(answers, 1), _answers(answers, 2)))

        by_block = lambda df: df.groupBy("block")
        by_bucket = lambda df: df.repartition(self.tasks, "bucket").groupBy("bucket")
        asked1 = by_block(self.docs).applyInPandas(ask1, MESSAGE)
        told1 = by_bucket(asked1).applyInPandas(_answering(answer1, 1), ANSWER)
        asked2 = by_block(self.docs).cogroup(by_block(told1)).applyInPandas(ask2, MESSAGE)
        told2 = by_bucket(asked2).applyInPandas(_answering(answer2, 2), ANSWER)
        return by_block(self.docs).cogroup(by_block(told1.unionByName(told2))).applyInPandas(end, schema)


def tidied(out: pd.DataFrame) -> pd.DataFrame:
    tidy()
    return out


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("ord", kind="stable", ignore_index=True)


def _answers(pdf: pd.DataFrame, turn: int) -> dict[int, bytes]:
    mine = pdf[pdf["turn"] == turn]
    return dict(zip(mine["bucket"], mine["payload"], strict=True))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def by_bucket(hashes: np.ndarray, n: int):
    """The order that groups ``hashes`` by bucket, and (bucket, first, last) of each group."""
    at = bucket_of(hashes, n)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
    return order, [(int(at[i]), i, j) for i, j in zip(first, [*first[1:], len(at)], strict=False)]


def _messages(block: int, n: int, asked) -> pd.DataFrame:
    """``asked``: hashes, and a function that gives the payload of an array of their indices."""
    hashes, payload = asked
    order, groups = by_bucket(hashes, n)
    rows = [(b, block, payload(order[i:j])) for b, i, j in groups]
    return pd.DataFrame(rows, columns=["bucket", "block", "payload"])


def _answering(answer, turn: int):
    def fn(key, pdf):
        pdf = pdf.sort_values("block", kind="stable", ignore_index=True)
        said = answer(list(pdf["payload"]))
        rows = [(b, turn, key[0], x) for b, x in zip(pdf["block"], said, strict=True) if x]
        return tidied(pd.DataFrame(rows, columns=["block", "turn", "bucket", "payload"]))

    return fn


def read_bits(hashes: np.ndarray, n: int, answers: dict[int, bytes], rows: int = 1) -> np.ndarray:
    """Per hash the bit that its bucket has answered; with ``rows``, so many bits, each row packed on its own."""
    order, groups = by_bucket(hashes, n)
    out = np.zeros((rows, len(hashes)), bool)
    for b, i, j in groups:
        if b in answers:
            got = np.frombuffer(answers[b], np.uint8).reshape(rows, -1)
            out[:, order[i:j]] = np.unpackbits(got, axis=1, count=j - i)
    return out if rows > 1 else out[0]


def write_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes() if bits.any() else b""


def asked_elsewhere(payloads: list[bytes]) -> list[bytes]:
    """For payloads of distinct hashes: which of them another payload has as well."""
    sizes = [len(p) // 8 for p in payloads]
    hashes = np.frombuffer(b"".join(payloads), np.uint64)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:]
    shared = np.empty(len(h), bool)
    shared[order] = same
    return [write_bits(x) for x in np.split(shared, np.cumsum(sizes)[:-1])]
