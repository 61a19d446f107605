"""Byte-level BPE by speculation: greedy tokens first, exact merging only where they are wrong.

A token sequence is what BPE gives exactly if every token encodes to itself and no merge crosses the border
of any adjacent pair before a merge inside one of its tokens. The greedy longest-match proposal of each new
word is therefore checked pair by pair, all distinct pairs of a batch at once in numpy; a word with a failing
pair is merged exactly. Words repeat, so results are kept in a cache of bounded size that is emptied when
full (a matter of speed only).
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import map_texts

#: The pre-tokenizer's pattern (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each cache's young generation.
CACHE_WORDS = 200_000
#: Longer pieces (in characters) are encoded, but not kept in a cache.
CACHE_CHARS = 40
#: Words above this many bytes are merged with a heap instead of list scans.
HEAP_BYTES = 200
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1
NONE_DUE = 1 << 62


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Generations:
    """A cache of two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, wanted: set) -> list:
        """What neither generation has; what only the old one has moves to the young one."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for w in wanted.difference(young):
            v = old.get(w)
            if v is None:
                out.append(w)
            else:
                young[w] = v
        return out


class Tokenizer:
    """A byte-level BPE vocabulary (a tokenizers JSON file) with encode and decode on whole texts."""

    def __init__(self, spec: str):
        import regex

        self.find = regex.compile(PATTERN).findall
        # other white space next to a space
        self.mixed = regex.compile(r"[^\S ](?: |(?<= .))", regex.DOTALL).search
        data = json.loads(spec)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for k, v in vocab.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        self.decimal = [str(i) for i in range(size)]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.vocab = vocab
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in data["model"]["merges"]]
        left = np.array([vocab[raw(a)] for a, _ in pairs])
        right = np.array([vocab[raw(b)] for _, b in pairs])
        made = np.array([vocab[raw(a) + raw(b)] for a, b in pairs])
        self.size = size
        # rank at which a token comes to be (-1: a byte), and its parts
        self.rank, self.left, self.right = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        self.rank[made[::-1]] = np.arange(len(made))[::-1]
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        keys = left.astype(np.int64) * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        # rank above, token below TOKEN_BITS: the least value is the merge that is due
        self.merge = {k: r << TOKEN_BITS | t for r, (k, t) in enumerate(zip(keys.tolist(), made.tolist()))}
        self.reach: dict[bytes, int] = {}  # longest token by its first two bytes
        for k in vocab:
            self.reach[k[:2]] = max(self.reach.get(k[:2], 1), len(k))
        self.sound = self._sound_tokens()
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.words, self.chunks = Generations(CACHE_WORDS), Generations(CACHE_WORDS)

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; a huge number if there is none."""
        key = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], 1 << 40)

    def compatible(self, x: np.ndarray, y: np.ndarray, within: bool = False) -> np.ndarray:
        """For each pair, whether no merge crosses its border. ``within``: the pair's own merge may.

        Walks back in time: of the two pieces that touch the border, the one made last is taken apart. While
        two pieces touch, their merge is due before ``until_x`` and ``until_y``, when a piece went into its
        larger one; of equal merges the left one comes first.
        """
        x, y = x.copy(), y.copy()
        until_x = np.full(len(x), 1 << 41)
        until_y = until_x.copy()
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        first = within
        while len(live):
            a, b = x[live], y[live]
            if not first:
                r = self._pair_rank(a, b)
                crossed = (r < (1 << 40)) & (r < until_x[live]) & (r <= until_y[live])
                good[live[crossed]] = False
                live, a, b = live[~crossed], a[~crossed], b[~crossed]
            first = False
            ra, rb = self.rank[a], self.rank[b]
            on = (ra >= 0) | (rb >= 0)
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_x = ra > rb
            i, j = live[undo_x], live[~undo_x]
            until_x[i], x[i] = ra[undo_x], self.right[a[undo_x]]
            until_y[j], y[j] = rb[~undo_x], self.left[b[~undo_x]]
        return good

    def _sound_tokens(self) -> np.ndarray:
        """Which tokens encode to themselves."""
        made = np.nonzero(self.rank >= 0)[0]
        sound = np.ones(self.size, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], within=True)
        for t in made[np.argsort(self.rank[made])].tolist():
            if not (sound[self.left[t]] and sound[self.right[t]]):
                sound[t] = False
        return sound

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches; every single byte is a token."""
        vocab, reach, at, n, out = self.vocab.get, self.reach.get, 0, len(word), []
        while at < n:
            end = at + reach(word[at : at + 2], 1)
            while (t := vocab(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = min(end, n)
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, the leftmost of equal ones first."""
        if len(word) > HEAP_BYTES:
            return self.exact_long(word)
        single, due, size = self.single, self.merge.get, self.size
        ids = [single[b] for b in word]
        ranks = [due(a * size + b, NONE_DUE) for a, b in zip(ids, ids[1:])]
        while ranks and (m := min(ranks)) != NONE_DUE:
            i = ranks.index(m)
            ids[i] = m & TOKEN_MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = due(ids[i] * size + ids[i + 1], NONE_DUE)
            if i:
                ranks[i - 1] = due(ids[i - 1] * size + ids[i], NONE_DUE)
        return ids

    def exact_long(self, word: bytes) -> list[int]:
        """The same with a heap of due merges over a linked list, near linear in the word."""
        from heapq import heapify, heappop, heappush

        ids = [self.single[b] for b in word]
        n, size, merge = len(ids), self.size, self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(m, i) for i in range(n - 1) if (m := merge(ids[i] * size + ids[i + 1]))]
        heapify(due)
        while due:
            m, i = heappop(due)
            j = after[i]
            if ids[i] < 0 or j >= n or merge(ids[i] * size + ids[j]) != m:
                continue
            ids[i], ids[j] = m & TOKEN_MASK, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge(ids[i] * size + ids[k]):
                    heappush(due, (m, i))
            if (h := before[i]) >= 0 and (m := merge(ids[h] * size + ids[i])):
                heappush(due, (m, h))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str], into: dict[str, bytes]) -> None:
        """Encodes each distinct word: proposals, one check of all pairs, exact merging of what fails."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(r) for r in raws]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        bad = np.zeros(len(words), bool)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad[owner[~self.sound[flat]]] = True
        same = np.nonzero(owner[1:] == owner[:-1])[0]
        pairs, where = np.unique(flat[same] * self.size + flat[same + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[same[~good[where]]]] = True
        for w, r, p, wrong in zip(words, raws, proposals, bad.tolist()):
            into[w] = array("i", self.exact(r) if wrong else p).tobytes()

    def parts(self, text: str) -> list[str]:
        """Pieces of a text that the pre-tokenizer's pattern never crosses, each encoded on its own.

        A lone space between two characters that are not white space always begins a token, so the text is cut
        there; where a space touches other white space the pattern cuts the whole text.
        """
        if "  " in text or self.mixed(text):
            return self.find(text)
        head, *rest = text.split(" ")
        return [head, *[" " + p for p in rest]] if head else [" " + p for p in rest]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [[(p, None if p not in self.special else self.special[p]) for p in self.split_special(t)] if any(s in t for s in self.special) else [(t, None)] for t in texts]
        parted = [[self.parts(p) if s is None else s for p, s in one] for one in cut]
        kept = self.chunks
        new = kept.missing({w for one in parted for p in one if not isinstance(p, int) for w in p})
        once: dict[str, bytes] = {}
        if new:
            cut_up = [(w, self.find(w)) for w in new]
            words = self.words.missing({w for _, p in cut_up for w in p})
            spelt: dict[str, bytes] = {}
            self.learn(words, spelt)
            self.words.young |= {w: v for w, v in spelt.items() if len(w) <= CACHE_CHARS}
            spell = self.words.young.get
            for w, p in cut_up:
                (kept.young if len(w) <= CACHE_CHARS else once)[w] = b"".join([spell(x) or spelt[x] for x in p])
        kept.young |= once
        get = kept.young.__getitem__
        out = []
        for one in parted:
            raw = b"".join([array("i", [p]).tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in one])
            out.append(np.frombuffer(raw, np.int32))
        for w in once:
            del kept.young[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(spec: str) -> Tokenizer:
    """The tokenizer of a JSON text, built once per process."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(spec)
    return _LOADED[key]


def _spec(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; null is empty and gives no ids. The driver reads ``path``."""
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))
    return map_texts(docs, lambda keys, texts: {"doc_id": keys, "ids": tokenizer(spec.value).encode(texts)}, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    from pyspark.sql import functions as F

    from lodestone.llm.common import ship

    spec = tokens.sparkSession.sparkContext.broadcast(_spec(path))
    ship(tokens.sparkSession)

    def over(batches):
        for batch in batches:
            t = tokenizer(spec.value)
            texts = [t.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id"), F.col("ids")).mapInArrow(over, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes every whole text in one pass.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and other columns do no harm.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_spec(path))

    def of(keys, texts: list[str]) -> dict:
        t = tokenizer(spec.value)
        counts, spelt, back = [], [], []
        for ids in t.encode(texts):
            listed = ids.tolist()
            counts.append(len(listed))
            spelt.append(hashlib.sha256(",".join(map(t.decimal.__getitem__, listed)).encode()).hexdigest())
            back.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return {"doc_id": keys, "n_tokens": counts, "ids_sha256": spelt, "decoded_sha256": back}

    return map_texts(docs, of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    from lodestone.session import table

    return round_trip(table(spark, sf_dir, "documents"))
