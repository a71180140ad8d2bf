"""Byte-pair vocabularies: loading, pre-tokens, and the two merge methods.

``ByteCounter`` (operator 7) counts tokens by popping the lowest-rank adjacent
pair from a heap over a linked list. ``PairIndexEncoder`` (operator 10) keeps,
for all new words of a batch, an index from a pair's rank to its positions and
applies the active ranks in ascending order.

A text is cut at spaces before any pattern runs: the pre-token patterns never
join characters across a space except one leading space, so each piece can be
encoded alone and remembered. Texts with characters outside a plain range or
with unusual white space are pre-tokenised whole by the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

from .common import MEMO_KEY, MEMO_LIMIT, worker_cache

# The pre-token patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pre-tokens without needless backtracking, for a matcher that has look-ahead.
BYTE_PATTERN_POSSESSIVE = r"'(?:[sdmt]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters on which every Unicode version agrees; others go to the library.
_PLAIN = r"\x20-\x7e\n\t\r¡-įı-ɏ‐-‧€"
_ODD_CHAR = re.compile(f"[^{_PLAIN}]")
_ODD_SPACES = ("  ", " \n", " \t", " \r", "\n ", "\t ", "\r ")

#: Characters of the longest text whose words are merged with those of others.
LONG_TEXT = 16_000_000
#: Runs of so much white space could use up the stack of a matcher with look-ahead.
LONG_SPACE = 1000
_LONG_SPACE = re.compile(r"[ \n\t\r]{%d}" % LONG_SPACE)


@lru_cache(maxsize=1)
def byte_letters() -> tuple[str, ...]:
    """The printable letter that byte-level vocabularies use for each byte:
    printable Latin-1 bytes stand for themselves, the others are numbered on
    from 256."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return tuple(out)


class Vocabulary:
    """Ranks of a merges file. ``rank`` maps a pair key to its rank; ``made``,
    ``left`` and ``right`` give the symbols of each rank."""

    SHIFT = 20

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer
        spec = json.loads(raw)
        model = spec["model"]
        self.library = Tokenizer.from_str(raw.decode("utf-8"))
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.rank: dict[int, int] = {}
        self.made, self.left, self.right = [], [], []
        latest: dict[str, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if latest.get(a + b) is not None:
                raise ValueError("a token with two merges is not supported")
            latest[a + b] = r
            self.rank[self.ids[a] << self.SHIFT | self.ids[b]] = r
            self.made.append(self.ids[a + b])
            self.left.append(self.ids[a])
            self.right.append(self.ids[b])
        first_use: dict[int, int] = {}
        for r in range(len(self.made)):
            first_use.setdefault(self.left[r], r)
            first_use.setdefault(self.right[r], r)
        if any(first_use.get(m, r + 1) <= r for r, m in enumerate(self.made)):
            raise ValueError("a token is merged on before the merge that makes it")
        self.by_byte = [self.ids.get(c) for c in byte_letters()]
        self.by_byte_end = [self.ids.get(c + self.suffix) for c in byte_letters()]
        self._cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        self.token_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}

    def parts(self, text: str) -> list[str]:
        """The text cut around special strings: even places ordinary text, odd
        places special strings, as the library's default treats them."""
        return self._cut.split(text) if self._cut else [text]

    def letters(self, piece: bytes) -> list[int]:
        """Symbols of a pre-token's bytes; bytes without a symbol are left out."""
        if not self.suffix:
            return [s for s in map(self.by_byte.__getitem__, piece) if s is not None]
        out = [self.by_byte[b] for b in piece[:-1]]
        out.append(self.by_byte_end[piece[-1]])
        return [s for s in out if s is not None]


_LETTER_BYTE: dict[str, int] = {}


def from_letters(word: str) -> bytes:
    """Bytes of a pre-token that the library returned as byte letters."""
    if not _LETTER_BYTE:
        _LETTER_BYTE.update({c: b for b, c in enumerate(byte_letters())})
    return bytes(map(_LETTER_BYTE.__getitem__, word))


_LOADED: dict[bytes, Vocabulary] = worker_cache()


def load(raw: bytes) -> Vocabulary:
    """A vocabulary per worker, keyed by the content of its file."""
    import hashlib
    key = hashlib.sha256(raw).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(raw)
    return _LOADED[key]


def plain(text: str) -> bool:
    return _ODD_CHAR.search(text) is None


def spaced_plainly(text: str) -> bool:
    return not (text[:1] == " " or text[-1:] == " " or any(s in text for s in _ODD_SPACES)) and _ODD_CHAR.search(text) is None


class ByteCounter:
    """Token counts of a byte-level vocabulary, without emitting ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(BYTE_PATTERN).findall
        self.tokens = _Memo(lambda word: self.merged(self.v.letters(word.encode("utf-8"))))
        self.inner = _Memo(lambda piece: self._sum(" " + piece))
        self.first = _Memo(self._sum)

    def _sum(self, piece: str) -> int:
        return sum(map(self.tokens.__getitem__, self.find(piece)))

    def merged(self, sym: list[int]) -> int:
        """Initial symbols minus merges: a heap of (rank, place) over a linked
        list; entries whose pair has changed since are passed over."""
        n = len(sym)
        if n < 2:
            return n
        rank, made, shift = self.v.rank, self.v.made, self.v.SHIFT
        bits = n.bit_length()
        mask = (1 << bits) - 1
        heap = []
        for i in range(n - 1):
            r = rank.get(sym[i] << shift | sym[i + 1])
            if r is not None:
                heap.append(r << bits | i)
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            i, r = top & mask, top >> bits
            j = after[i]
            if j >= n or sym[i] < 0 or rank.get(sym[i] << shift | sym[j]) != r:
                continue
            new = sym[i] = made[r]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                q = rank.get(new << shift | sym[k])
                if q is not None:
                    push(heap, q << bits | i)
            p = before[i]
            if p >= 0:
                q = rank.get(sym[p] << shift | new)
                if q is not None:
                    push(heap, q << bits | p)
            merges += 1
        return n - merges

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.v.parts(text)):
            if k % 2:
                total += 1
            elif not part:
                continue
            elif spaced_plainly(part):
                pieces = part.split(" ")
                total += self.first[pieces[0]] + sum(map(self.inner.__getitem__, pieces[1:]))
            else:
                total += sum(self.tokens[from_letters(w).decode("utf-8")]
                             for w, _ in self.v.library.pre_tokenizer.pre_tokenize_str(part))
        for memo in (self.tokens, self.inner, self.first):
            memo.trim()
        return total


class _Memo(dict):
    """A dictionary that computes what it lacks; emptied when it grows large.
    Keys of over MEMO_KEY characters (unbroken code, base64) are computed each
    time, so that its bytes are bounded and not its entries alone."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        value = self.fn(key)
        if len(key) <= MEMO_KEY:
            self[key] = value
        return value

    def trim(self, limit: int = MEMO_LIMIT) -> None:
        if len(self) > limit:
            self.clear()


class PairIndexEncoder:
    """Encoding by an index from pair ranks to positions, and decoding."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = regex.compile(WORD_PATTERN).findall
        self.known: dict[str, tuple[int, str, str]] = {}
        self.word_runs: dict[bytes, tuple[int, str, str]] = {}

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word: one linked list over all words, one index
        rank -> positions, ranks applied in ascending order."""
        v = self.v
        rank, shift = v.rank, v.SHIFT
        sym: list[int] = []
        starts: list[int] = []
        after: list[int] = []
        before: list[int] = []
        index: dict[int, list[int]] = {}
        for w in words:
            at = len(sym)
            own = v.letters(w)
            n = len(own)
            starts.append(at if n else -1)
            if not n:
                continue
            sym += own
            before.append(-1)
            before.extend(range(at, at + n - 1))
            after.extend(range(at + 1, at + n))
            after.append(-1)
            for i in range(n - 1):
                r = rank.get(own[i] << shift | own[i + 1])
                if r is not None:
                    if r in index:
                        index[r].append(at + i)
                    else:
                        index[r] = [at + i]
        active = list(index)
        heapq.heapify(active)
        pop, push = heapq.heappop, heapq.heappush
        while active:
            r = pop(active)
            left, right, new = v.left[r], v.right[r], v.made[r]
            places = index.pop(r)
            places.sort()
            for i in places:
                if sym[i] != left:
                    continue
                j = after[i]
                if j < 0 or sym[j] != right:
                    continue
                sym[i] = new
                sym[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    q = rank.get(new << shift | sym[k])
                    if q is not None:
                        if q in index:
                            index[q].append(i)
                        else:
                            index[q] = [i]
                            push(active, q)
                p = before[i]
                if p >= 0:
                    q = rank.get(sym[p] << shift | new)
                    if q is not None:
                        if q in index:
                            index[q].append(p)
                        else:
                            index[q] = [p]
                            push(active, q)
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(sym[at])
                at = after[at]
            out.append(ids)
        return out

    def pieces(self, part: str) -> list[str]:
        """White-space pieces of plain text, or the library's normal form."""
        return part.split()

    def words(self, piece: str) -> list[bytes]:
        return [w.encode("utf-8") for w in self.find(piece.lower())]

    def library_words(self, part: str) -> list[bytes]:
        t = self.v.library
        return [from_letters(w) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))]

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """For each text its runs (number of ids, ids joined by a space, tokens
        joined by a space)."""
        for memo in (self.known, self.word_runs):
            if len(memo) > MEMO_LIMIT:
                memo.clear()
        plan: list[list] = []
        new: dict[str, list[bytes]] = {}
        for text in texts:
            own: list = []
            for k, part in enumerate(self.v.parts(text)):
                if k % 2:
                    own.append((1, str(self.v.special[part]), part))
                elif plain(part):
                    own.append(self.pieces(part))
                elif part:
                    key = "\0" + part
                    own.append([key])
                    if key not in self.known:
                        new[key] = self.library_words(part)
            plan.append(own)
        wanted = set()
        for own in plan:
            for x in own:
                if type(x) is list:
                    wanted.update(x)
        for piece in wanted.difference(self.known):
            if piece not in new:
                new[piece] = self.words(piece)
        runs_of = self.word_runs
        fresh_words = list({w for ws in new.values() for w in ws}.difference(runs_of))
        token_of = self.v.token_of
        for w, ids in zip(fresh_words, self.merge_all(fresh_words)):
            runs_of[w] = (len(ids), " ".join(map(str, ids)), " ".join(map(token_of.__getitem__, ids)))
        fresh = {}
        for piece, ws in new.items():
            if len(ws) == 1:
                fresh[piece] = runs_of[ws[0]]
            else:
                own = [r for r in map(runs_of.__getitem__, ws) if r[0]]
                fresh[piece] = (sum(r[0] for r in own), " ".join([r[1] for r in own]), " ".join([r[2] for r in own]))
        known = self.known
        known.update({k: x for k, x in fresh.items() if k[0] != "\0"})
        out = []
        for own in plan:
            runs = []
            for x in own:
                if type(x) is list:
                    runs.extend(fresh[p] if p in fresh else known[p] for p in x) if x and x[0][:1] == "\0" \
                        else runs.extend(map(known.__getitem__, x))
                else:
                    runs.append(x)
            out.append(runs)
        # what is long is known for this call only, so that the memos' bytes are bounded
        for memo, fresh_keys in ((known, new), (runs_of, fresh_words)):
            for key in fresh_keys:
                if len(key) > MEMO_KEY:
                    memo.pop(key, None)
        return out


class ByteEncoder:
    """Token ids of a byte-level vocabulary, as its own library gives them.

    Plain text is merged by the rank file of the same vocabulary (the ids are
    the ranks), one text by itself through a memo of its pieces; other text goes
    to the library whole. Of many texts, those that are spaced plainly are cut
    at spaces, and each distinct word of the call is merged once: a memo does
    not help where most words are new."""

    MARK, CUT = "\0", "\1"                     # neither is a plain character

    def __init__(self, vocabulary: Vocabulary):
        import numpy as np
        import tiktoken
        self.v = vocabulary
        apart = set(vocabulary.special.values())
        ranks = {from_letters(t): i for t, i in vocabulary.ids.items() if i not in apart}
        self.mark = max(vocabulary.token_of) + 1
        self.width = np.zeros(self.mark + 1, np.int32)          # bytes of a token
        self.width[list(ranks.values())] = list(map(len, ranks))
        self.width[self.mark] = 1
        own = tiktoken.Encoding("own", pat_str=BYTE_PATTERN_POSSESSIVE, mergeable_ranks=ranks, special_tokens={self.MARK: self.mark})
        self.merge = lambda text: own.encode_to_numpy(text, allowed_special={self.MARK}, disallowed_special=())
        self.inner = _Memo(lambda piece: self.merge(" " + piece).tobytes())
        self.first = _Memo(lambda piece: self.merge(piece).tobytes())

    def encode(self, text: str):
        import numpy as np
        out: list[bytes] = []
        for k, part in enumerate(self.v.parts(text)):
            if k % 2:
                out.append(np.uint32(self.v.special[part]).tobytes())
            elif not part:
                continue
            elif not plain(part) or _LONG_SPACE.search(part):
                out.append(np.array(self.v.library.encode(part, add_special_tokens=False).ids, np.uint32).tobytes())
            elif spaced_plainly(part):
                pieces = part.split(" ")
                out.append(self.first[pieces[0]])
                out.extend(map(self.inner.__getitem__, pieces[1:]))
            else:
                out.append(self.merge(part).tobytes())
        self.inner.trim()
        self.first.trim()
        return np.frombuffer(b"".join(out), dtype=np.uint32)

    def encode_all(self, texts: list[str]) -> list:
        """The ids of every text, as ``encode`` gives them."""
        import numpy as np
        easy = [len(t) <= LONG_TEXT and len(self.v.parts(t)) == 1 and spaced_plainly(t) for t in texts]
        merged = iter(self._words_merged([t for t, e in zip(texts, easy) if e]))
        return [next(merged) if e else self.encode(t) for t, e in zip(texts, easy)]

    def _words_merged(self, texts: list[str]) -> list:
        """The ids of texts that are spaced plainly. Every word keeps the space
        before it and the first of a text has a mark instead, so that all
        distinct words in a row are merged as each would be alone."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        if not texts:
            return []
        cut = pc.split_pattern(pa.array([self.MARK + t.replace(" ", self.CUT + " ") for t in texts], pa.large_string()), self.CUT)
        first_word = np.asarray(cut.offsets)[:-1]
        coded = cut.flatten().dictionary_encode()
        word_of, words = np.asarray(coded.indices), coded.dictionary
        length = pc.binary_length(words).to_numpy()
        if any(_LONG_SPACE.search(words[int(i)].as_py()) for i in np.flatnonzero(length >= LONG_SPACE)):
            return [self.encode(t) for t in texts]
        ids = self.merge(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar("", words.type))[0].as_py())
        at, ends = np.cumsum(self.width[ids]), np.cumsum(length)    # where each token and each word ends
        stop = np.searchsorted(at, ends) + 1                    # tokens up to the end of each word
        start = np.concatenate([[0], stop[:-1]])
        start += ids[start] == self.mark
        n = (stop - start)[word_of]
        upto = np.cumsum(n)
        places = np.repeat(start[word_of] - (upto - n), n)
        places += np.arange(len(places))
        counts = np.add.reduceat(n, first_word)
        return np.split(ids[places], np.cumsum(counts)[:-1])
