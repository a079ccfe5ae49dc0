"""Token counts by greedy longest match in linear time, without building tokens.

The vocabulary is a trie over bytes.  Each node has a failure link and a number
of popped tokens: when the next byte has no edge, the longest tokens of the
bytes read so far are counted at once and the walk goes on at the node of what
is left of them.  So every byte is read once and no token is ever cut out.

Texts are cut into chunks by a pattern before; within a chunk the longest
vocabulary entry is taken from the left, again and again.  A chunk with a byte
that no entry starts with counts as one unknown token.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published chunk pattern of the byte-level vocabularies.
CHUNK = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose counts a worker keeps, and the longest one kept.
_KNOWN_CHUNKS, _KNOWN_CHARS = 300_000, 48
_NONE = -1


class Automaton:
    """The trie of a vocabulary with failure links and popped-token counts."""

    def __init__(self, vocabulary: Iterable[bytes], pattern: str = CHUNK):
        self.pattern = pattern
        self.edges: list[dict[int, int]] = [{}]
        ends = {0}
        for token in vocabulary:
            node = 0
            for byte in token:
                follow = self.edges[node].get(byte)
                if follow is None:
                    follow = self.edges[node][byte] = len(self.edges)
                    self.edges.append({})
                node = follow
            ends.add(node)
        # Level by level: a node that ends a token pops just that one; another one pops what its
        # parent would, and more, until the rest can be read on by this node's byte.
        self.fail, self.pops = [_NONE] * len(self.edges), [0] * len(self.edges)
        level = [0]
        while level:
            deeper = []
            for parent in level:
                for byte, node in self.edges[parent].items():
                    deeper.append(node)
                    if node in ends:
                        self.fail[node], self.pops[node] = 0, 1
                        continue
                    rest, popped = self.fail[parent], self.pops[parent]
                    while rest != _NONE and byte not in self.edges[rest]:
                        popped += self.pops[rest]
                        rest = self.fail[rest]
                    if rest != _NONE:
                        self.fail[node], self.pops[node] = self.edges[rest][byte], popped
            level = deeper
        self._known: dict[str, int] = {}
        self._chunks = None

    def count_bytes(self, chunk: bytes) -> int | None:
        """Tokens in ``chunk``; None if some byte can't be read."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node = n = 0
        for byte in chunk:
            follow = edges[node].get(byte)
            while follow is None:
                n += pops[node]
                node = fail[node]
                if node == _NONE:
                    return None
                follow = edges[node].get(byte)
            node = follow
        while node:
            n += pops[node]
            node = fail[node]
            if node == _NONE:
                return None
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(tokens, chunks, unknown chunks) of ``text``."""
        if not text:
            return 0, 0, 0
        if self._chunks is None:
            self._chunks = regex.compile(self.pattern)
        known, tokens, chunks, unknown = self._known, 0, 0, 0
        for chunk, times in Counter(self._chunks.findall(text)).items():
            n = known.get(chunk, _NONE)
            if n == _NONE:
                n = self.count_bytes(chunk.encode("utf-8", "surrogatepass")) or 0
                if len(chunk) <= _KNOWN_CHARS:
                    if len(known) >= _KNOWN_CHUNKS:
                        known.clear()
                    known[chunk] = n
            tokens += times * (n or 1)
            chunks += times
            unknown += times * (n == 0)
        return tokens, chunks, unknown

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_chunks": None}


def read_vocabulary(path: str) -> Iterator[bytes]:
    """The entries of a vocabulary file: lines of a base64 entry and its rank."""
    with open(path, "rb") as lines:
        for line in lines:
            if entry := line.split():
                yield base64.b64decode(entry[0])


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_chunks`` and ``n_unknown`` (replacing columns of these names).

    ``docs`` has a column text and any others.  The automaton is shared with the
    executors as a broadcast; its size is that of the vocabulary, not of the data.

    Defined cases: null and empty texts have no tokens; white space counts as
    the pattern cuts it; repeated rows are counted one by one; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.arrow_udf("struct<n_tokens: long, n_chunks: long, n_unknown: long>")
    def counted(texts: pa.Array) -> pa.Array:
        found = [shared.value.count(text.as_py()) for text in texts]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "n_chunks", "n_unknown"])

    names = ("n_tokens", "n_chunks", "n_unknown")
    found = docs.drop(*names).withColumn("__counted", counted("text"))
    return found.withColumns({name: F.col(f"__counted.{name}") for name in names}).drop("__counted")
