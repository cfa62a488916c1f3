"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token labels and accepts exactly the token sequences that the merge rules produce. It starts with one
state that every base symbol loops on. The gadget of a merge (u, v), in rule order, copies the state that u leads to
without its arc v, leads all arcs u to the copy, and adds an arc uv, to where v led, beside every arc u. All arcs of one
label lead to one state, and an arc is missing from a state only for a removed label and for labels merged later from it
on the left. In preorder of the left-part tree, younger children first, these labels are one interval for each gadget,
so a state's table is a list of interval bounds. A word is encoded by walking the tables: of the tokens that start at a
position, the state's arcs allow those that continue the one right tokenization of each prefix.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sheafwork.llm.common import pieces

#: White space of the tokenizer's normaliser; str.split() also splits at \x1c-\x1f.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
MORE_BLANKS = re.compile("[\x1c-\x1f]")
#: Stands for the word end; no character of a byte-level alphabet.
END = "\n"
#: Chunks whose characters all lie below this need no library to split: letters and digits there have been settled long ago.
PLAIN = "\u0250"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARKS = frozenset(".,;:!?|")
#: Chunks remembered by each of the two generations of a cache.
REMEMBERED = 200_000


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        size = max(vocab.values()) + 1
        born = np.full(size, -1, np.int64)  # merge that made the token; -1 for base symbols
        children: list[list[int]] = [[] for _ in range(size)]
        made = set()
        for k, (u, v) in enumerate(merges):
            t = vocab[u + (v if not u.endswith(suffix) else v)]
            born[t] = k
            children[vocab[u]].append(t)
            made.add(t)
        base = [i for i in vocab.values() if i not in made]
        # preorder of the left-part tree, younger children first
        self.pre, last, count, stack = [0] * size, [0] * size, 0, [(t, False) for t in reversed(base)]
        while stack:
            t, done = stack.pop()
            if done:
                last[t] = count
                continue
            self.pre[t] = count
            count += 1
            stack.append((t, True))
            stack.extend((c, False) for c in children[t])  # ascending, so the youngest is on top
        # states: parent and interval of removed labels; state 0 has all arcs
        self.parent, self.removed = [-1], [(0, 0)]
        self.target = [0] * size
        self._tables: dict[int, list[int]] = {0: []}
        live = [False] * size
        for t in base:
            live[t] = True
        for k, (u, v) in enumerate(merges):
            a, b, t = vocab[u], vocab[v], vocab[u + v]
            q = self.target[a]
            if not (live[a] and live[b] and self._climbs(q, b)):
                continue  # the pair never stands side by side
            live[t] = True
            younger = [c for c in children[b] if born[c] >= k]
            self.parent.append(q)
            self.removed.append((self.pre[b], last[younger[0]] if younger else self.pre[b] + 1))
            self.target[t] = self.target[b]
            self.target[a] = len(self.parent) - 1
        # trie of the labels that have arcs, as nested dicts; the key "" holds (preorder number, token)
        self.trie: dict = {}
        for label, t in vocab.items():
            if live[t]:
                node = self.trie
                for symbol in self.symbols(label):
                    node = node.setdefault(symbol, {})
                node[""] = (self.pre[t], t)
        self.labels = {t: label for label, t in vocab.items()}

    def _climbs(self, state: int, label: int) -> bool:
        at = self.pre[label]
        while state > 0:
            low, high = self.removed[state]
            if low <= at < high:
                return False
            state = self.parent[state]
        return True

    def table(self, state: int) -> list[int]:
        """Bounds of the intervals of missing labels, in order: a label is missing if an odd number of bounds precede it."""
        found = self._tables.get(state)
        if found is None:
            spans, s = [], state
            while s > 0:
                spans.append(self.removed[s])
                s = self.parent[s]
            found = []
            for low, high in sorted(spans):
                if found and low <= found[-1]:
                    found[-1] = max(found[-1], high)
                else:
                    found += [low, high]
            self._tables[state] = found
        return found

    def symbols(self, label: str) -> str:
        """Characters of a label, with one END character for the word end."""
        if self.suffix and label.endswith(self.suffix):
            return label[:-len(self.suffix)] + END
        return label

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given in the model's characters without the word end.

        A position is reached by one right tokenization only, so it has one state and is tried once: longest label first,
        back from where no allowed label goes on.
        """
        text = word + END if self.suffix else word
        n, target, trie = len(text), self.target, self.trie
        out: list[int] = []
        places, choices = [0], []
        tried = {0}
        missing: list[int] = []
        while True:
            at = places[-1]
            node, i, found = trie, at, []
            while i < n:
                node = node.get(text[i])
                if node is None:
                    break
                i += 1
                if "" in node:
                    found.append((i, *node[""]))
            while True:
                while found:
                    i, order, t = found.pop()
                    if i not in tried and not bisect_right(missing, order) & 1:
                        break
                else:
                    # no label goes on from here
                    places.pop()
                    out.pop()
                    found = choices.pop()
                    missing = self.table(target[out[-1]]) if out else []
                    continue
                break
            out.append(t)
            if i == n:
                return out
            tried.add(i)
            choices.append(found)
            places.append(i)
            missing = self.table(target[t])


def byte_characters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Model:
    """A tokenizer file: its own normaliser and word split, special tokens, and the automaton of its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(vocab, merges, model["end_of_word_suffix"] or "")
        self.labels = self.automaton.labels | {i: s for s, i in self.special.items()}
        self.digits = {i: str(i) for i in self.labels}
        self.words: dict[str, list[int]] = {}
        alphabet = [c for c, _ in self.library.pre_tokenizer.pre_tokenize_str("é")]  # shows that words come in byte characters
        self.bytes = byte_characters()
        split = [x for x in spec["pre_tokenizer"].get("pretokenizers", []) if x["type"] == "Split"]
        self.plain = alphabet == ["é".encode().decode("latin-1").translate(self.bytes)] and \
            [x["pattern"].get("Regex") for x in split] == [WORDS.pattern] and \
            [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]

    def split(self, part: str) -> list[str]:
        """Words of a text without white space or special tokens, in the model's characters."""
        if self.plain and max(part) < PLAIN and "\u0130" not in part:
            low = part.lower()  # composed already: a base below PLAIN composes with marks beyond it only
            words = [low] if low.isalpha() else WORDS.findall(low)
            return words if low.isascii() and low.isprintable() else [
                w.encode().decode("latin-1").translate(self.bytes) for w in words]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Tokens of a text without white space."""
        out: list[int] = []
        for part in self.cut.split(chunk) if self.cut and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.split(part):
                    ids = self.words.get(word)
                    if ids is None:
                        if len(self.words) >= REMEMBERED:
                            self.words.clear()
                        ids = self.words[word] = self.automaton.encode_word(word)
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels joined by one space, as a tokenizer without decoder does; unknown ids have no label."""
        return " ".join(self.labels[i] for i in ids if i in self.labels)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model for each Python worker."""
    return Model(path)


def parted(chunk: str) -> tuple[str, str] | None:
    """A chunk of letters, lower-cased, and the one mark behind them, if that is all it is and its case is plain."""
    if not chunk.isascii() and (max(chunk) >= PLAIN or "\u0130" in chunk):
        return None
    word, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in MARKS else (chunk, "")
    return (word.lower(), mark) if word.isalpha() else None


def chunks(text: str) -> list[str]:
    """Parts between white space; no token crosses white space."""
    if MORE_BLANKS.search(text):
        return [c for c in BLANKS.split(text) if c]
    return text.split()


class Remembered:
    """A cache of bounded size in two generations: what was asked for lately stays."""

    def __init__(self, make: Callable[[list[str]], list], size: int = REMEMBERED):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def get(self, keys: list[str]) -> list:
        young = self.young
        out = list(map(young.get, keys))
        gaps = [i for i, v in enumerate(out) if v is None]
        if gaps:
            missing = list(dict.fromkeys([keys[i] for i in gaps]))
            old = self.old
            new = [k for k in missing if k not in old]
            found = dict(zip(new, self.make(new)))
            fresh = {k: found[k] if k in found else old[k] for k in missing}
            for i in gaps:
                out[i] = fresh[keys[i]]
            if len(young) + len(fresh) > self.size:
                self.old, self.young = young, fresh if len(fresh) <= self.size else {}
            else:
                young |= fresh
        return out


def encoder(path: str):
    def forms(new: list[str]) -> list[tuple[int, str, str]]:
        m, out = model(path), []
        for chunk in new:
            ids = m.encode_chunk(chunk)
            out.append((len(ids), " ".join([m.digits[i] for i in ids]), m.decode(ids)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(("forms", path), forms)
        for batch in pieces(batches, limit=1 << 20):
            n_tokens, ids, labels = [], [], []
            for text in batch.column("text").to_pylist():
                got = [x for x in cache.get(chunks(text or "")) if x[0]]
                n_tokens.append(sum(x[0] for x in got))
                ids.append(" ".join([x[1] for x in got]))
                labels.append(" ".join([x[2] for x in got]))
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(labels, pa.string())],
                names=[*batch.schema.names, "n_tokens", "ids", "decoded"])

    return run


_CACHES: dict[tuple, Remembered] = {}


def worker_cache(name: tuple, make: Callable[[list[str]], list]) -> Remembered:
    """Kept between the tasks of one Python worker."""
    return _CACHES.setdefault(name, Remembered(make))


def digests(path: str):
    """As encoder(), but with the SHA-256 of ids and decoded text in their place, so that neither leaves the task."""
    inner = encoder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            columns = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in batch.column(c).to_pylist()])
                       for c in ("ids", "decoded")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), *columns],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` and n_tokens, ids (decimal, joined by one space), decoded (arc labels joined by one space).

    ``path`` names a tokenizer file that every executor can read. Null and empty texts have no tokens. Rows are
    independent: repeated rows and rows without doc_id are encoded like any other. Columns of the three new names are
    replaced; other columns stay, whatever their names.
    """
    docs = docs.drop("n_tokens", "ids", "decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(encoder(path), f"{schema}, n_tokens bigint, ids string, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded text of encode_documents()."""
    return docs.select("doc_id", "text").mapInArrow(
        digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
