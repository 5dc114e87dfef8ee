"""Byte-pair encoding and decoding with a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the right
tokenizations. It starts with one state in which every byte may follow. The gadget of merge (u, v) -> w takes the
arc v out of the state behind u, gives the arc w to every state that has the arc u, and lets w lead to the state
that v led to. Every token leads to one state whatever came before it, so the automaton is the relation "b may
follow a"; written out it would have up to |V| squared arcs, so a gadget only records when its token was made, of
what, and when which arc went, and an arc is compiled from these records when it is first needed and kept in a
transition table. A pre-split word is encoded by walking the table along the word's bytes; decoding emits the arcs'
labels.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, map_arrow, slices

#: Fixed value: the pre-tokenizer of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The automaton of byte-level merges; tokens are ids, labels their bytes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        size = max(vocab.values()) + 1
        self.labels: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.labels[i] = bytes(letters[c] for c in token)
        self.born = [0] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[int, int] = {}  # arc -> when its gadget took it out
        self.width = size
        self.arcs: dict[int, bool] = {}
        made = {i for i in range(size) if len(self.labels[i]) == 1}
        for when, (a, b) in enumerate(merges, 1):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in made or u not in made or v not in made:
                raise ValueError(f"merge {when} ({a!r}, {b!r}) makes no new token of made ones")
            if self._open(u, v, when - 1):  # else no text ever reaches the gadget
                made.add(w)
                self.born[w], self.left[w], self.right[w] = when, u, v
                self.cut[u * size + v] = when
            else:
                raise ValueError(f"merge {when} ({a!r}, {b!r}) can never apply")
        # labels by their bytes: (node, byte) -> node, and the token that ends at a node
        self.steps: dict[int, int] = {}
        self.ends = [-1]
        self.sizes = list(map(len, self.labels))
        self.longest = max(self.sizes)
        for i in made:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                node = self.steps.get(key) or self.steps.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i

    def _open(self, a: int, b: int, when: int) -> bool:
        """Whether the arc b leaves the state behind a once the gadgets up to `when` are in."""
        born, cut, width = self.born, self.cut, self.width
        while True:
            gone = cut.get(a * width + b)
            if gone is not None and gone <= when:
                return False
            x, y = born[a], born[b]
            if not x and not y:
                return True
            if x > y:  # a's gadget led it to the state behind its right part
                when, a = x - 1, self.right[a]
            else:  # b's gadget gave b to the states that had its left part
                when, b = y, self.left[b]

    def open(self, a: int, b: int) -> bool:
        key = a * self.width + b
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= 2_000_000:
                self.arcs.clear()
            known = self.arcs[key] = self._open(a, b, 1 << 60)
        return known

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-split word: the one path of open arcs whose labels spell it.

        The walk takes the longest label with an open arc and steps back from places without any. A place is only
        reached by the one right tokenization of what stands before it, so no place is left twice, and a walk reads at
        most the longest label from any place: the time is linear in the word.
        """
        n, steps, ends, sizes, arcs, width, longest = len(word), self.steps, self.ends, self.sizes, self.arcs, self.width, self.longest
        path: list[int] = []
        left: list[list[int]] = []  # of each token on the path, shorter labels that were not tried
        dead: set[int] = set()
        at, here = 0, -1
        choice: list[int] | None = None
        while at < n:
            if choice is None:
                choice, node = [], 0
                for byte in word[at : at + longest]:
                    node = steps.get(node << 8 | byte)
                    if node is None:
                        break
                    if ends[node] >= 0:
                        choice.append(ends[node])
            while choice:
                i = choice.pop()
                if here >= 0:
                    known = arcs.get(here * width + i)
                    if known is None:
                        known = self.open(here, i)
                    if not known:
                        continue
                if not dead or at + sizes[i] not in dead:
                    path.append(i)
                    left.append(choice)
                    at += sizes[i]
                    here, choice = i, None
                    break
            else:
                if not path:
                    raise ValueError(f"no tokenization of {word!r}")
                dead.add(at)
                at -= sizes[path.pop()]
                here, choice = path[-1] if path else -1, left.pop()
        return path


class Tokenizer:
    """Whole texts to ids and back, with bounded caches of words."""

    def __init__(self, path: str, cached: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges)
        self.split = regex.compile(SPLIT)
        self.irregular = regex.compile(r"\s\s")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.labels = list(self.automaton.labels)
        for content, i in self.special.items():
            self.labels += [b""] * (i + 1 - len(self.labels))
            self.labels[i] = content.encode()
        self.names = list(map(str, range(len(self.labels))))
        self.words = RecentCache(self._word, cached)
        self.first = RecentCache(lambda piece: tuple(self._plain(piece)), cached // 16)
        self.spaced = RecentCache(lambda piece: tuple(self._plain(" " + piece)), cached)

    def _word(self, word: str) -> tuple:
        return tuple(self.automaton.encode(word.encode("utf-8", "surrogatepass")))

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split.findall(text))))

    def _run(self, text: str) -> list[int]:
        # with single white space only, no pre-token spans the start of a space: pieces between spaces stand alone
        if self.irregular.search(text):
            return self._plain(text)
        head, *rest = text.split(" ")
        return list(chain(self.first[head], chain.from_iterable(map(self.spaced.__getitem__, rest))))

    def encode(self, text: str) -> list[int]:
        if self.at_special is None or not any(s in text for s in self.special):
            return self._run(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._run(text[at : m.start()]) if m.start() > at else []
            out.append(self.special[m[0]])
            at = m.end()
        return out + (self._run(text[at:]) if at < len(text) else [])

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of each whole text.

    Null and empty texts have no ids; null ids and repeated rows stay rows of their own; an empty table gives an empty result; other columns
    are ignored. Special tokens' strings in a text become their ids.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield {"id": part.column("id"), "ids": [t.encode(x or "") for x in part.column("text").to_pylist()]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, f"id {kind}, ids array<int>", run).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of token ids; null ids give an empty text."""
    kind = rows.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            yield {"id": batch.column("id"), "text": [t.decode(x or ()) for x in batch.column("ids").to_pylist()]}

    return map_arrow(rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), f"id {kind}, text string", run).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, as digests.

    The same cases as encode_texts; null and empty texts have the digests of empty strings.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        t = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                n, ids_hash, text_hash = [], [], []
                for x in part.column("text").to_pylist():
                    ids = t.encode(x or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(t.names.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
                yield {"id": part.column("id"), "n_tokens": pa.array(n, type=pa.int64()), "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", run).withColumnRenamed("id", id_col)
