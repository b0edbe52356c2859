"""Toxicity scores of texts whose disguised words a noisy channel restores first."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.calibrate import fit_calibration, labelled, remainder
from contactlake.llm.tables import highest, log_level, on_workers, stage
from contactlake.llm.textarrays import blocks, mix, powers, string_block

# Bytes of texts that a task works on at once: its arrays take some twenty times as much.
BLOCK_BYTES = 1 << 20
# Words and word beginnings kept at most, the most telling first.
LEXICON = 65_536
PREFIXES = (3, 4, 5, 6)
RAW_MOST = 24.0
# What speaks against chance, in nats, if words fell on toxic rows by the rows' share; the bar is the same for any number of rows.
EVIDENCE = 8.0
GAIN = 2.0

# Letters that a sign may stand for.
DISGUISES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a",
             "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
# Letters of another alphabet that look like plain ones.
ALIKE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
         "і": "i", "ѕ": "s", "ј": "j"}
DISGUISES |= ALIKE
# Signs that may stand between the letters of one word, and those that nobody sees.
SEPARATORS = ".-_*~'"
HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

# Costs of the channel in nats: reading a sign as a letter, dropping a separator, dropping a repeated letter, keeping as is.
SIGN, SEPARATE, REPEAT, KEEP = 1.0, 0.7, 0.7, 0.0
ALPHABET = 32
_OTHER, _EDGE = 27, 0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER[[0xC2]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in [*DISGUISES, *SEPARATORS] if ord(c) < 128]] = True
# Bytes of the signs of more than one byte: those of HIDDEN and the two of DISGUISES.
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in [*HIDDEN, "€", "£"]]
_ALIKE_HEAD = np.zeros(256, bool)
_ALIKE_HEAD[[c.encode()[0] for c in ALIKE]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.full(256, _OTHER, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 28


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 28 if ord(ch) > 127 else _OTHER


class CharModel:
    """Letters given the two before them, from counts of plain words, with the shorter history mixed in."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
        one = (c.sum(axis=(0, 1)) + 0.5) / (c.sum() + 0.5 * ALPHABET)
        pair = c.sum(axis=0)
        two = (pair + 2.0 * one) / (pair.sum(axis=1, keepdims=True) + 2.0)
        three = (c + 2.0 * two[None]) / (c.sum(axis=2, keepdims=True) + 2.0)
        self.costs = -np.log(three)
        self.cost = self.costs.tolist()


def restore_word(word: str, model: CharModel, breaks: bool = True) -> str:
    """Cheapest plain reading of a lower-cased word: Viterbi over its lattice of readings.

    Each sign may stay, become one of its letters or, as a separator or a repeated letter,
    vanish; what nobody sees vanishes always.  What stays and is no letter ends the word before it and starts another; a space
    costs nothing either way.  Without ``breaks`` no sign or space stays.  The state is the last two
    letters of the reading; readings are chained from the back, so a word may have any length.
    """
    cost = model.cost
    # last two letters -> cost, reading as (reading before, letter)
    front: dict[tuple[int, int], tuple[float, tuple | None]] = {(_EDGE, _EDGE): (0.0, None)}
    before = ""
    for ch in word:
        letter = (ch.isalpha() or _code(ch) == 28) and ch not in HIDDEN
        options = [(ch, KEEP)] * letter + [(c, SIGN) for c in DISGUISES.get(ch, "")]
        drop = (0.0 if ch == " " or ch in HIDDEN else SEPARATE if ch in SEPARATORS else REPEAT if ch == before and letter else None)
        stay = not letter and ch not in HIDDEN and (breaks or drop is None and ch not in DISGUISES)
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (spent, text) in sorted(front.items(), key=lambda f: f[0]):
            row = cost[a][b]
            for c, price in options:
                code = _code(c)
                total, key = spent + price + row[code], (b, code)
                if key not in nxt or total < nxt[key][0]:
                    nxt[key] = (total, (text, c))
            if drop is not None and ((a, b) not in nxt or spent + drop < nxt[a, b][0]):
                nxt[a, b] = (spent + drop, text)
            if stay:
                total = spent + (row[_EDGE] if b != _EDGE else 0.0)
                if (_EDGE, _EDGE) not in nxt or total < nxt[_EDGE, _EDGE][0]:
                    nxt[_EDGE, _EDGE] = (total, (text, ch))
        front = nxt
        before = ch if ch != " " and ch not in HIDDEN else before
    text = min(((spent + (cost[a][b][_EDGE] if b != _EDGE else 0.0), text) for (a, b), (spent, text) in sorted(front.items(), key=lambda f: f[0])),
               key=lambda r: r[0])[1]
    out = []
    while text is not None:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


# Words of more characters are read one by one: a batch takes as many steps as its longest word has characters.
TOGETHER = 48


def restore_words(words: list[str], model: CharModel, breaks: bool = True) -> list[str]:
    """The readings of ``restore_word``, of all words at once.

    All words are at the same place of their lattices.  What is open there is one flat list of (word,
    state, cost, reading); a step extends it by the options of each word's character and keeps the
    cheapest of each state of a word.  Readings are chained from the back.
    """
    out = [""] * len(words)
    size = np.array([len(w) for w in words], np.int64)
    for i in np.flatnonzero(size > TOGETHER).tolist():
        out[i] = restore_word(words[i], model, breaks)
    order = np.flatnonzero((size > 0) & (size <= TOGETHER))
    order = order[np.argsort(-size[order], kind="stable")]
    if not len(order):
        return out
    size = size[order]
    text = np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.cumsum(size) - size
    char, kind = np.unique(text, return_inverse=True)
    seen = [chr(c) for c in char.tolist()]
    # of each character: up to three readings, what dropping it costs, whether it may stay as it is
    most = 3
    reads, codes = np.zeros((len(seen), most), np.uint32), np.zeros((len(seen), most), np.int64)
    price, count = np.zeros((len(seen), most)), np.zeros(len(seen), np.int64)
    fall, letter, sign = np.full(len(seen), np.inf), np.zeros(len(seen), bool), np.zeros(len(seen), bool)
    for i, ch in enumerate(seen):
        letter[i] = (ch.isalpha() or _code(ch) == 28) and ch not in HIDDEN
        sign[i] = ch in DISGUISES
        options = [(ch, KEEP)] * bool(letter[i]) + [(c, SIGN) for c in DISGUISES.get(ch, "")]
        count[i] = len(options)
        for k, (c, p) in enumerate(options):
            reads[i, k], codes[i, k], price[i, k] = ord(c), _code(c), p
        fall[i] = 0.0 if ch == " " or ch in HIDDEN else SEPARATE if ch in SEPARATORS else np.inf
    # the character before, spaces and what nobody sees aside
    blank = np.array([ch == " " or ch in HIDDEN for ch in seen])[kind]
    last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(text))))
    before = np.r_[-1, last[:-1]]
    again = (before >= np.repeat(at, size)) & (text[before] == text) & letter[kind]
    drop = np.where(np.isinf(fall[kind]) & again, REPEAT, fall[kind])
    hidden = np.array([ch in HIDDEN for ch in seen])[kind]
    stay = ~letter[kind] & ~hidden & (breaks | np.isinf(drop) & ~sign[kind])

    cost = model.costs.ravel()
    word, state = np.arange(len(order)), np.zeros(len(order), np.int64)
    spent, link = np.zeros(len(order)), np.full(len(order), -1, np.int64)
    ended, parents, chars, nodes = [], [], [], 0
    for place in range(int(size[0])):
        open_words = int(np.searchsorted(-size, -place, "left"))
        cut = int(np.searchsorted(word, open_words))
        if cut < len(word):
            ended.append((word[cut:], state[cut:], spent[cut:], link[cut:]))
            word, state, spent, link = word[:cut], state[:cut], spent[:cut], link[:cut]
        spot = at[word] + place
        c, end = kind[spot], state % ALPHABET
        parts = []
        for k in range(most):
            pick = np.flatnonzero(count[c] > k)
            if len(pick):
                code = codes[c[pick], k]
                parts.append((word[pick], end[pick] * ALPHABET + code,
                              spent[pick] + price[c[pick], k] + cost[state[pick] * ALPHABET + code], link[pick], reads[c[pick], k], True))
        pick = np.flatnonzero(np.isfinite(drop[spot]))
        if len(pick):
            parts.append((word[pick], state[pick], spent[pick] + drop[spot[pick]], link[pick], np.zeros(len(pick), np.uint32), False))
        pick = np.flatnonzero(stay[spot])
        if len(pick):
            closing = np.where(end[pick] != _EDGE, cost[state[pick] * ALPHABET + _EDGE], 0.0)
            parts.append((word[pick], np.full(len(pick), _EDGE), spent[pick] + closing, link[pick], text[spot[pick]], True))
        fresh = np.concatenate([np.full(len(p[0]), p[5]) for p in parts])
        word, state, spent, link, read = (np.concatenate([p[i] for p in parts]) for i in range(5))
        key = word * (ALPHABET * ALPHABET) + state
        best = np.lexsort((spent, key))
        key = key[best]
        best = best[np.r_[True, key[1:] != key[:-1]]]
        word, state, spent, link, read, fresh = (x[best] for x in (word, state, spent, link, read, fresh))
        parents.append(link[fresh])
        chars.append(read[fresh])
        link[fresh] = nodes + np.arange(len(chars[-1]))
        nodes += len(chars[-1])
    ended.append((word, state, spent, link))
    word, state, spent, link = (np.concatenate([e[i] for e in ended]) for i in range(4))
    spent = spent + np.where(state % ALPHABET != _EDGE, cost[state * ALPHABET + _EDGE], 0.0)
    best = np.lexsort((spent, word))
    at_last = link[best[np.r_[True, word[best][1:] != word[best][:-1]]]]
    parent, char = np.concatenate(parents), np.concatenate(chars)
    back = []
    while (at_last >= 0).any():
        on = at_last >= 0
        back.append(np.where(on, char[at_last], 0xFFFFFFFF).astype(np.uint32))
        at_last = np.where(on, parent[at_last], -1)
    if back:
        grid = np.stack(back[::-1], axis=1)
        kept = grid != 0xFFFFFFFF
        whole = grid[kept].tobytes().decode("utf-32-le", "surrogatepass")
        upto = np.cumsum(kept.sum(axis=1)).tolist()
        for i, a, b in zip(order.tolist(), [0, *upto], upto):
            out[i] = whole[a:b]
    return out


def plain_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters of a block: start, end and document of each."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(ink & ~(np.r_[False, ink[:-1]] & ~edge[:-1]))
    end = np.flatnonzero(ink & ~(np.r_[ink[1:], False] & ~edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def _inside(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Places of signs of more than one byte, and of letters that only look plain beside plain ones."""
    hit = np.zeros(len(data), bool)
    high = np.flatnonzero(data >= 0xC2)
    if not len(high):
        return hit
    for w in _WIDE:
        at = high[data[high] == w[0]]
        at = at[at + len(w) <= len(data)]
        for k in range(1, len(w)):
            at = at[data[at + k] == w[k]]
        hit[at] = True
    head = high[_ALIKE_HEAD[data[high]]]
    plain = (_LOWER[data] >= 97) & (_LOWER[data] <= 122)
    after, back = np.minimum(head + 2, len(data) - 1), np.maximum(head - 1, 0)
    hit[head] |= plain[after] & (head + 2 < len(data)) & ~edge[after] | plain[back] & (head > 0) & ~edge[head]
    return hit


def disguised(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Spans that may hide a word: a sign beside a letter, a letter twice, letters set apart.

    Spans are whole words or runs of words of one character, so no two overlap.
    """
    start, end = _disguised(data, at)
    return list(zip(start.tolist(), end.tolist()))


def _disguised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = np.flatnonzero(ink & ~(np.r_[False, ink[:-1]] & ~edge[:-1]))
    end = np.flatnonzero(ink & ~(np.r_[ink[1:], False] & ~edge[1:])) + 1
    letter, sign = _LETTER[data], _SIGN[data]
    hit = _inside(data, edge)
    hit[:-1] |= (sign[:-1] & letter[1:] | letter[:-1] & sign[1:]) & ~edge[1:n]
    hit[:-1] |= (_LOWER[data[1:]] == _LOWER[data[:-1]]) & letter[1:] & ~edge[1:n]
    hit &= ink
    word = np.zeros(len(start) + 1, np.int64)
    np.cumsum(np.add.reduceat(hit, start) if len(start) else [], out=word[1:])
    word = np.flatnonzero(np.diff(word))
    # at least three single letters or signs in a row, in one document, with any space between
    lone = (end - start == 1) & (letter[start] | sign[start])
    doc = np.searchsorted(at, start, "right")
    follows = np.r_[False, lone[1:] & lone[:-1] & (doc[1:] == doc[:-1])][:len(start)]
    head = np.flatnonzero(lone & ~follows)
    tail = np.flatnonzero(lone & ~np.r_[follows[1:], False][:len(start)])
    long = tail - head >= 2
    spans = np.concatenate([start[word], start[head[long]]]), np.concatenate([end[word], end[tail[long]]])
    order = np.argsort(spans[0], kind="stable")
    return spans[0][order], spans[1][order]


class Restorer:
    """Blocks with disguised words written plainly.

    Spans of a block are told apart by a hash of their bytes; each is decoded once, together with
    the others that are new, and remembered by its text in two generations of bounded size.
    """

    def __init__(self, model: CharModel, remember: int = 150_000):
        self._model, self._remember = model, remember
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def readings(self, words: list[str]) -> list[str]:
        """The plain readings, and where that gives other words the ones that no sign ends."""
        first = restore_words(words, self._model)
        # without a sign or a space both readings are the same
        mixed = [i for i, w in enumerate(words) if not w.isalpha()]
        second = restore_words([words[i] for i in mixed], self._model, breaks=False)
        for i, r in zip(mixed, second):
            if first[i] != r and _WORD.findall(first[i]) != _WORD.findall(r):
                first[i] = f"{first[i]} {r}"
        return first

    def _known(self, spans: list[str]) -> list[bytes]:
        new = list({s for s in spans if s not in self._young and s not in self._old})
        found = dict(zip(new, (r.encode() for r in self.readings(new))))
        for s in spans:
            if s not in found and s in self._old and s not in self._young:
                found[s] = self._old[s]
        out = [found[s] if s in found else self._young[s] for s in spans]
        self._young.update((s, r) for s, r in found.items() if len(s) <= 64)
        if len(self._young) > self._remember:
            self._young, self._old = {}, self._young
        return out

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = _disguised(data, at)
        if not len(start):
            return data, at
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_STEP, n)[:n], out=total[1:])
        h = mix((total[end] - total[start]) * powers(pow(_STEP, -1, 1 << 64), n)[start] + (end - start).astype(np.uint64))
        _, first, group = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        spans = [" ".join(raw[a:b].decode("utf-8", "replace").lower().split())
                 for a, b in zip(start[first].tolist(), end[first].tolist())]
        new = self._known(spans)
        # pieces in turn: what stands before a span, then its reading; the rest of the block last
        pool = np.frombuffer(b"".join(new), np.uint8)
        size = np.array([len(x) for x in new], np.int64)
        begin = np.cumsum(size) - size
        upto = np.r_[0, end[:-1]]
        source, length = np.empty(2 * len(start) + 1, np.int64), np.empty(2 * len(start) + 1, np.int64)
        source[:-1:2], length[:-1:2] = upto, start - upto
        source[1::2], length[1::2] = n + begin[group], size[group]
        source[-1], length[-1] = end[-1], n - end[-1]
        both = np.concatenate([data, pool])
        out_at = np.cumsum(length) - length
        taken = both[np.repeat(source - out_at, length) + np.arange(int(length.sum()))]
        grown = np.r_[0, np.cumsum(size[group] - (end - start))]
        return taken, at + grown[np.searchsorted(start, at, "left")]


_WORD = re.compile(r"[^\W\d_]+")
_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each letter run: the whole word, then its beginnings (0 where it is no longer), and its document."""
    start, end, doc = plain_runs(data, at)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * powers(_STEP, n), out=total[1:])
    back = powers(pow(_STEP, -1, 1 << 64), n)[start] if n else np.zeros(0, np.uint64)
    out = [mix((total[end] - total[start]) * back + (end - start).astype(np.uint64) * np.uint64(2))]
    for k in PREFIXES:
        long = end - start > k
        h = np.zeros(len(start), np.uint64)
        h[long] = mix((total[start[long] + k] - total[start[long]]) * back[long] + np.uint64(2 * k + 1))
        out.append(h)
    return np.stack(out), doc


class Lexicon:
    """Weights of word features, looked up behind a bitmap."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray):
        order = np.argsort(feature)
        self.feature, self.weight = feature[order], weight[order]
        self._seen = np.zeros(1 << 20, bool)
        self._seen[feature >> np.uint64(44)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape)
        if len(self.feature):
            maybe = np.nonzero(self._seen[h >> np.uint64(44)])
            v = h[maybe]
            i = np.minimum(np.searchsorted(self.feature, v), len(self.feature) - 1)
            out[maybe] = np.where(self.feature[i] == v, self.weight[i], 0.0)
        return out


def raw_scores(lexicon: Lexicon, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each document the weight of its most toxic word, and half that of the second."""
    rows = len(at) - 1
    h, doc = word_features(data, at)
    if not len(doc):
        return np.zeros(rows)
    weight = lexicon(h).max(axis=0)
    hit = weight > 0
    order = np.lexsort((-weight[hit], doc[hit]))
    w, d = weight[hit][order], doc[hit][order]
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
    out = np.zeros(rows)
    out[d[first]] = w[first]
    second = first[(first + 1 < len(d))]
    second = second[d[second + 1] == d[second]]
    out[d[second]] += 0.5 * w[second + 1]
    return np.minimum(out, RAW_MOST)


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_remainder: int = 1,
                    threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    lexicon_size: int = LEXICON) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A model of three letters is counted over all labelled texts.  With it, words that hold signs
    beside letters, a letter twice or letters set apart, of any length, are read anew by Viterbi over the
    readings of their characters.  Restored words and word beginnings are weighed by how much
    more often they stand in toxic rows; a row's raw score is its weightiest word and half the
    next, calibrated on folds that the weights have not seen.  Every label is learned from whose id has another
    remainder than ``held_remainder``; the others are not seen.

    Null and empty texts hold no word and get the lowest score.  A null id is never held out and
    has no label; of copies one is learned from, of repeated ids every text.  Without labels every score is
    0.5.  Other columns, also ones named like these, are ignored.
    """
    rest = remainder(id_col, modulus)
    known = stage(labelled(labels, label_col, rest == held_remainder, id_col=id_col)
                  .withColumn("fold", (F.floor(F.crc32(F.col("doc_id").cast("string")) / modulus) % 2).cast("int")))
    texts = on_workers(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # copies of a text would make its chance words look telling; labels grow with the texts, so they are not sent to all tasks
    known = stage(texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy")).join(known.hint("shuffle_hash"), "doc_id")
                  .groupBy("copy", "label").agg(F.min_by(F.struct("doc_id", "fold"), "doc_id").alias("r"))
                  .select("r.doc_id", "r.fold", "label"))
    fit = stage(texts.join(known.hint("shuffle_hash"), "doc_id").select("text", "label", "fold"))

    def letters(batches):
        counts = np.zeros(ALPHABET ** 3, np.int64)
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                data, at = string_block(b.column("text"))
                start, end, _ = plain_runs(data, at)
                if not len(start):
                    continue
                # every run between two edges
                code = np.zeros(int((end - start).sum()) + 2 * len(start), np.int64)
                size = end - start + 2
                begin = np.cumsum(size) - size
                body = np.ones(len(code), bool)
                body[begin] = body[begin + size - 1] = False
                code[body] = _CODE[_LOWER[data[_LETTER[data]]]]
                one, two, three = code[:-2], code[1:-1], code[2:]
                ok = np.ones(len(code) - 2, bool)
                ok[begin[1:] - 1] = False       # a window over the gap between two words
                ok[begin[1:] - 2] = False
                counts += np.bincount((one[ok] * ALPHABET + two[ok]) * ALPHABET + three[ok], minlength=len(counts))
                # the first letter after two edges
                counts += np.bincount(code[begin + 1], minlength=len(counts))
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has])], names=["gram", "n"])

    # at most ALPHABET^3 rows
    grams = fit.select("text").mapInArrow(letters, "gram INT, n LONG").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET ** 3, np.int64)
    counts[[g.gram for g in grams]] = [g.n for g in grams]
    model = CharModel(counts)

    def plain(batches):
        restore = Restorer(model)
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                data, at = restore(*string_block(b.column("text")))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([texts.cast(pa.binary()), b.column("label"), b.column("fold")], names=["text", "label", "fold"])

    # read twice
    restored = stage(fit.mapInArrow(plain, "text BINARY, label INT, fold INT"))

    def features(batches):
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                label, fold = b.column("label").to_numpy(), b.column("fold").to_numpy()
                h, doc = word_features(*string_block(b.column("text")))
                kind = (label * 2 + fold)[np.tile(doc, len(h))] if len(doc) else np.zeros(0, np.int64)
                flat = h.ravel()
                # once a document
                key = np.lexsort((np.tile(doc, len(h)), flat))
                f, d, k = flat[key], np.tile(doc, len(h))[key], kind[key]
                keep = (f != 0) & np.r_[True, (f[1:] != f[:-1]) | (d[1:] != d[:-1])] if len(f) else np.zeros(0, bool)
                f, k = f[keep], k[keep]
                at = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
                group = np.cumsum(np.r_[True, f[1:] != f[:-1]]) - 1 if len(f) else np.zeros(0, np.int64)
                n = np.bincount(group * 4 + k, minlength=4 * len(at)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(f[at].view(np.int64)), *(pa.array(n[:, c]) for c in range(4))],
                                                 names=["feature", "c0", "c1", "t0", "t1"])

    rows_of = {(r.label, r.fold): r["count"] for r in known.groupBy("label", "fold").count().collect()}
    clean_rows, toxic_rows = ([rows_of.get((l, f), 0) for f in (0, 1)] for l in (0, 1))
    per_fold = (restored.mapInArrow(features, "feature LONG, c0 LONG, c1 LONG, t0 LONG, t1 LONG")
                .groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "t0", "t1")]))

    def evidence(t, c, tox: int, cl: int, log, most):
        """Rows of a feature times the relative entropy of its toxic share; of columns or arrays, by their log and maximum."""
        q = (tox + 1.0) / (tox + cl + 2.0)
        return t * log(most(t, 1) / ((t + c) * q)) + c * log(most(c, 1) / ((t + c) * (1.0 - q)))

    def telling(fold: int | None):
        """Score of a feature by the rows of one fold, or of both; null where it does not tell enough."""
        t, c = (F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")) if fold is None else (F.col(f"t{fold}"), F.col(f"c{fold}"))
        tox, cl = (sum(toxic_rows), sum(clean_rows)) if fold is None else (toxic_rows[fold], clean_rows[fold])
        gain = F.log((t + 0.1) / (tox + 1.0)) - F.log((c + 0.5) / (cl + 1.0))
        sure = evidence(t, c, tox, cl, F.log, lambda a, b: F.greatest(a, F.lit(b))) >= EVIDENCE
        return F.when((t >= 2) & (gain > GAIN) & sure, gain * F.sqrt(t))

    best = F.greatest(telling(None), telling(0), telling(1))
    listed = stage(per_fold.where(best.isNotNull()))
    # at most lexicon_size rows of five numbers
    found = highest(listed, log_level(best), lexicon_size).toPandas()
    f = found["feature"].to_numpy(np.int64).view(np.uint64)
    c, t = found[["c0", "c1"]].to_numpy(float).reshape(-1, 2), found[["t0", "t1"]].to_numpy(float).reshape(-1, 2)

    def weighed(fold: int | None) -> Lexicon:
        """Lexicon of one fold's rows alone, or of both."""
        pick = [0, 1] if fold is None else [fold]
        tox, cl = t[:, pick].sum(axis=1), c[:, pick].sum(axis=1)
        n, m = sum(toxic_rows[k] for k in pick), sum(clean_rows[k] for k in pick)
        gain = np.log((tox + 0.1) / (n + 1.0)) - np.log((cl + 0.5) / (m + 1.0))
        w = gain - 1.0 / np.sqrt(tox + 0.1)
        seen = tox + cl > 0
        sure = np.zeros(len(tox), bool)
        sure[seen] = evidence(tox[seen], cl[seen], n, m, np.log, np.maximum) >= EVIDENCE
        use = (tox >= 2) & (gain > GAIN) & (w > 0) & sure
        return Lexicon(f[use], w[use])

    whole, by_other = weighed(None), [weighed(1), weighed(0)]

    def other_fold(batches):
        for batch in batches:
            for b in blocks(batch, "text", BLOCK_BYTES):
                block = string_block(b.column("text"))
                both = np.stack([raw_scores(x, *block) for x in by_other])
                raw = both[b.column("fold").to_numpy(), np.arange(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(raw), b.column("label")], names=["raw", "label"])

    curve = fit_calibration(restored.mapInArrow(other_fold, "raw DOUBLE, label INT"), 0.0, RAW_MOST)
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def score(batches):
        restore = Restorer(model)
        for batch in batches:
            for b in blocks(batch, text_col, BLOCK_BYTES):
                raw = raw_scores(whole, *restore(*string_block(b.column(text_col))))
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(curve(raw))], names=["doc_id", "score"])

    scored = docs.select(id_col, text_col).mapInArrow(score, f"doc_id {id_type}, score DOUBLE")
    return scored.select("doc_id", F.coalesce(remainder("doc_id", modulus) == held_remainder, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
