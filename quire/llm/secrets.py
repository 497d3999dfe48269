"""Secret scans: grammar inference over labelled credentials.

For each kind of labelled string, credentials and ordinary ones alike, a prefix tree of its values is
generalised to a probabilistic automaton: states of any depth whose next-symbol and ending frequencies
are compatible (Hoeffding's bound, and so on down their subtrees) are merged, smaller prefixes first, so
that parts of any length become loops and fixed lengths stay. A symbol is a character where a format
shows few at that place of its beginning, and one for all letters and digits after that.

A candidate is every part of a run of RUN characters that begins at a word and ends with one, or with the
padding ``=`` after it, of any length, wherever it stands (after ``=``, ``/``, ``:``, ``-`` and so on), and the body of
every armoured block (``-----BEGIN``), which is judged as a whole only. It is followed from its start until no credential's automaton
accepts it: a character that a format never shows, or more marks than any of its labelled values has,
ends it. Its score is the largest log-likelihood under a credential's kind less the largest under an
ordinary one, where a kind's likelihood is that of its automaton times that of what stands around the
string (the two words and separators before it and the character after it, frequencies learned from the
same rows); words within labelled ordinary strings are a kind of their own. So what looks like a digest is a secret after ``token =`` and none after ``commit``. Scores
above a threshold set between both sorts of labelled rows are secrets; of those that overlap, the one
of the larger score stays (then the earlier, then the shorter).

The labelled rows are a table (``before``, ``value``, ``after``, ``kind``, ``secret``), or those of
``secret_labels``. Of each kind at most SAMPLE rows are used, of values of at most VALUE_BYTES bytes;
null or empty values, those that aren't ASCII and rows without a kind are left out.

Null and empty texts have no secrets. Texts are scanned whole. Candidates of one text may repeat: each is
its own row. Equal scores of two formats go to the first in the order of their names. Repeated rows
give repeated findings. Without labelled credentials nothing is found. Redacting leaves other columns
as they are, but for ``n_chars`` if it is there, which follows the text; null texts stay null.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import BYTE_VALUE, U64, WORD, chunks, mix, powers, raw, rows_mapped, slim, spans, strings
from quire.llm.secret_labels import Row, labelled_credentials

ALPHA = 0.05
#: Labelled rows of each kind that the automata are inferred from, at most, and the bytes of a value of them.
SAMPLE = 400
VALUE_BYTES = 4096
#: A word or separator seen around fewer labelled rows counts as unknown.
SEEN = 4
REDACTED = "[SECRET]"
MARKS = "_-+/=.~!$*#%"
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
RUN = ALNUM.copy()
RUN[[ord(c) for c in MARKS]] = True
KINDS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"]
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Symbol of any letter or digit; the others are ASCII codes.
BODY = 128
UNKNOWN, NONE = 0, 1
ARMOUR = re.compile(rb"-----BEGIN [A-Z0-9 ]+-----(?:\s|\\n|\\r)*((?:[A-Za-z0-9+/=]{16,}(?:\s|\\r|\\n)+)*[A-Za-z0-9+/=]{16,}(?:(?:\s|\\r|\\n)+[A-Za-z0-9+/=]{1,63}(?=(?:\s|\\r|\\n)*-----END))?)")
BREAKS = re.compile(rb"\\r|\\n|\s+")


def hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function of the 64-bit hash of each ``data[start:end]``, the same wherever it stands."""
    up, down = powers(data.size + 1)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE_VALUE[data] * up[: data.size])])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[int, int]] = [{}]
        self.times: list[dict[int, int]] = [{}]
        self.ends, self.seen, self.depth = [0], [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.body: Counter = Counter()
        self.marks = max((sum(not c.isalnum() for c in s) for s in samples), default=0)
        self._grow([s.encode() for s in samples])
        self._generalise()
        self._compile()

    def _grow(self, samples: list[bytes]) -> None:
        todo = [(0, samples, True)]
        while todo:
            node, own, literal = todo.pop()
            at = self.depth[node]
            self.seen[node], self.ends[node] = len(own), sum(len(s) == at for s in own)
            following = defaultdict(list)
            for s in own:
                if len(s) > at:
                    following[s[at]].append(s)
            plain = [c for c in following if ALNUM[c]]
            literal = literal and len(plain) <= math.log2(max(len(own), 1))
            if plain and not literal:
                self.body.update({c: len(following[c]) for c in plain})
                following[BODY] = [s for c in plain for s in following.pop(c)]
            for x, rest in sorted(following.items()):
                self.next[node][x], self.times[node][x] = len(self.next), len(rest)
                todo.append((len(self.next), rest, literal))
                self.next.append({})
                self.times.append({})
                self.ends.append(0)
                self.seen.append(0)
                self.depth.append(at + 1)

    def _differs(self, a: int, n: int, b: int, m: int) -> bool:
        return bool(n and m) and abs(a / n - b / m) > self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if self._differs(self.ends[p], n, self.ends[q], m):
                return False
            one, other = self.times[p], self.times[q]
            if (BODY in one) != (BODY in other) and any(x == BODY or ALNUM[x] for x in one) and any(x == BODY or ALNUM[x] for x in other):
                return False
            for x in one.keys() | other.keys():
                if self._differs(one.get(x, 0), n, other.get(x, 0), m):
                    return False
                if x in one and x in other:
                    todo.append((self.next[p][x], self.next[q][x]))
        return True

    def _fold(self, p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for x, n in self.times[q].items():
                self.times[p][x] = self.times[p].get(x, 0) + n
                if x in self.next[p]:
                    todo.append((self.next[p][x], self.next[q][x]))
                else:
                    self.next[p][x] = self.next[q][x]

    def _generalise(self) -> None:
        self.red = [0]
        while True:
            known = set(self.red)
            blue = [(self.depth[to], to, r, x) for r in self.red for x, to in self.next[r].items() if to not in known]
            if not blue:
                return
            _, q, parent, x = min(blue)
            for r in self.red:
                if self._compatible(r, q):
                    self.next[parent][x] = r
                    self._fold(r, q)
                    break
            else:
                self.red.append(q)

    def _compile(self) -> None:
        """Next states and log-probabilities by state and character, -1 and -inf where the format never shows it."""
        number = {s: i for i, s in enumerate(self.red)}
        body = dict(self.body)
        for k in KINDS:
            if sum(ord(c) in self.body for c in k) >= 3:
                body |= {ord(c): 0.5 for c in k if ord(c) not in self.body}
        total = sum(body.values())
        self.to = np.full((len(self.red), 256), -1, np.int32)
        self.log = np.full((len(self.red), 256), -np.inf)
        self.end = np.full(len(self.red), -np.inf)
        for s, i in number.items():
            all_ = self.seen[s]
            if self.ends[s]:
                self.end[i] = math.log(self.ends[s] / all_)
            for x, to in self.next[s].items():
                p = math.log(self.times[s][x] / all_)
                for c, share in body.items() if x == BODY else [(x, total)]:
                    self.to[i, c], self.log[i, c] = number[to], p + math.log(share / total)


def any_string(samples: list[str]) -> Automaton:
    """A first-order model of the kinds of characters that accepts every string: what an ordinary one may be if of no kind."""
    classes = [*KINDS, *MARKS]
    of = {c: i for i, s in enumerate(classes) for c in s}
    n = len(classes)
    times, ends = np.full((n + 1, n), 0.5), np.full(n + 1, 0.5)
    for s in samples:
        state = n
        for c in s:
            if c in of:
                times[state, of[c]] += 1
                state = of[c]
        ends[state] += 1
    made = Automaton.__new__(Automaton)
    made.marks, made.red = 1 << 30, list(range(n + 1))
    made.to, made.log = np.full((n + 1, 256), -1, np.int32), np.full((n + 1, 256), -np.inf)
    total = times.sum(1) + ends
    for c, i in of.items():
        made.to[:, ord(c)], made.log[:, ord(c)] = i, np.log(times[:, i] / total / len(classes[i]))
    made.end = np.log(ends / total)
    return made


class Machine:
    """The automata of some kinds in one table of states."""

    def __init__(self, automata: list[Automaton]):
        first = np.cumsum([0, *(len(a.red) for a in automata)])
        self.start = first[:-1].astype(np.int32)
        self.to = np.concatenate([np.where(a.to < 0, -1, a.to + f) for a, f in zip(automata, first, strict=False)]).astype(np.int32) if automata else np.zeros((0, 256), np.int32)
        self.log = np.concatenate([a.log for a in automata]) if automata else np.zeros((0, 256))
        self.end = np.concatenate([a.end for a in automata]) if automata else np.zeros(0)
        self.marks = np.array([a.marks for a in automata], np.int64)

    def __len__(self) -> int:
        return self.start.size

    def follow(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, kind and log-likelihood of all strings that begin at one of ``starts``, end at a place marked in ``stop`` up to its ``ends`` and that a kind accepts."""
        of, kind = np.nonzero((self.to[self.start] >= 0).T[data[starts]])
        state, like, marks = self.start[kind], np.zeros(of.size), np.zeros(of.size, np.int64)
        at, last = starts[of], ends[of]
        out = []
        while of.size:
            byte = data[at]
            to = self.to[state, byte]
            marks += ~ALNUM[byte]
            going = np.flatnonzero((to >= 0) & (marks <= self.marks[kind]))
            like = like[going] + self.log[state[going], byte[going]]
            of, kind, state, marks, at, last = of[going], kind[going], to[going], marks[going], at[going] + 1, last[going]
            done = np.flatnonzero(stop[at] & (self.end[state] > -np.inf))
            out.append((of[done], at[done], kind[done], like[done] + self.end[state[done]]))
            going = np.flatnonzero(at < last)
            of, kind, state, marks, at, last, like = of[going], kind[going], state[going], marks[going], at[going], last[going], like[going]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def whole(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of each ``data[start:end]`` by kind, -inf where it isn't accepted."""
        got = np.full((starts.size, len(self)), -np.inf)
        order = np.argsort(starts - ends, kind="stable")
        s, size, live, i = starts[order], (ends - starts)[order], starts.size, 0
        k = len(self)
        state, like, kind = np.tile(self.start, (s.size, 1)), np.zeros((s.size, k)), np.arange(k)
        marks = np.zeros(s.size, np.int64)
        while True:
            over = int(np.searchsorted(-size, -i, "left"))
            got[order[over:live]] = np.where((state[over:live] >= 0) & (marks[over:live, None] <= self.marks[kind]), like[over:live] + self.end[state[over:live]], -np.inf)
            live = over
            if not live:
                return got
            byte = data[s[:live] + i]
            dead = state[:live] < 0
            like[:live] += np.where(dead, -np.inf, self.log[state[:live], byte[:, None]])
            state[:live] = np.where(dead, -1, self.to[state[:live], byte[:, None]])
            marks[:live] += ~ALNUM[byte]
            i += 1


def surroundings(off: np.ndarray, rows: np.ndarray, starts: np.ndarray, prev: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], between: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Hashes of the last word before each start (number ``prev`` of ``words``), the one before that, and the separators after both; 0 for a word that isn't there."""
    ws, we, h = words
    out = np.zeros((4, starts.size), U64)
    begin, until = off[rows], starts
    for k in range(2):
        at = np.maximum(prev - k, 0)
        there = (prev >= k) & (ws[at] >= begin)
        out[k] = np.where(there, h[at], U64(0))
        out[2 + k] = mix(between(np.where(there, we[at], begin), until) + U64(k + 1))
        until = np.where(there, ws[at], begin)
    return out


@dataclass
class Scanner:
    names: list[str]
    credential: Machine
    ordinary: Machine
    #: Hashes known at each of the four places, and the log-frequency of each by kind (credentials first); of the character after, by code or 256.
    known: list[np.ndarray] = field(default_factory=list)
    around: list[np.ndarray] = field(default_factory=list)
    after: np.ndarray | None = None
    threshold: float = np.inf

    def _context(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the distinct contexts each start has, and their log-likelihoods by kind."""
        key = np.zeros(places.shape[1], np.int64)
        for known, h in zip(self.known, places, strict=True):
            at = np.minimum(np.searchsorted(known, h), max(known.size - 1, 0))
            code = np.where(h == U64(0), NONE, np.where(known[at] == h, at + 2, UNKNOWN)) if known.size else np.where(h == U64(0), NONE, UNKNOWN)
            key = key * (known.size + 2) + code
        distinct, which = np.unique(key, return_inverse=True)
        total, rest = np.zeros((distinct.size, len(self.credential) + len(self.ordinary))), distinct
        for known, table in zip(self.known[::-1], self.around[::-1], strict=True):
            total += table[rest % (known.size + 2)]
            rest = rest // (known.size + 2)
        return which, total

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last byte, format and score of each secret."""
        none = np.zeros(0, np.int64)
        off, data = raw(texts)
        if not data.size or not len(self.credential):
            return none, none, none, none, np.zeros(0)
        ws, we, wr = spans(off, data)
        runs = spans(off, data, RUN)
        of_bytes = hasher(data)
        words = ws, we, hasher(LOWERED[data])(ws, we)
        stop = np.ones(data.size + 1, bool)
        stop[1:-1] = ~(WORD[data[:-1]] & WORD[data[1:]])
        stop[off] = True
        # a candidate ends with a letter, a digit or padding
        stop[1:] &= ALNUM[data] | (data == 61)
        begins = np.flatnonzero(ALNUM[data[ws]])
        blocks = self._armoured(off, data, words, of_bytes)
        if blocks[0].size:
            edge = np.zeros(data.size + 1, np.int64)
            np.add.at(edge, blocks[1], 1)
            np.add.at(edge, blocks[2], -1)
            begins = begins[np.cumsum(edge)[ws[begins]] == 0]
        starts, rows = ws[begins], wr[begins]
        ends = runs[1][np.searchsorted(runs[0], starts, "right") - 1] if starts.size else starts
        context, likes = self._context(surroundings(off, rows, starts, begins - 1, words, of_bytes)) if starts.size else (starts, np.zeros((0, 1)))
        # equal rests of runs are followed once, and equal rests in equal surroundings judged once
        rest = mix(of_bytes(starts, ends) + stop[ends].astype(U64))
        _, first, which = np.unique(rest, return_index=True, return_inverse=True)
        of, to, kind, like = self.credential.follow(data, starts[first], ends[first], stop)
        order = np.argsort(of, kind="stable")
        of, to, kind, like = of[order], to[order], kind[order], like[order]
        cut = np.searchsorted(of, np.arange(first.size + 1))
        some = np.flatnonzero((cut[1:] > cut[:-1])[which])
        pairs, pair = np.unique(which[some] * np.int64(len(likes)) + context[some], return_inverse=True)
        times = np.diff(cut)[pairs // max(len(likes), 1)]
        end = np.cumsum(times)
        of_pair = np.repeat(np.arange(pairs.size), times)
        item = np.arange(of_pair.size) - np.repeat(end - times, times) + np.repeat(cut[pairs // max(len(likes), 1)], times)
        c = pairs[of_pair] % max(len(likes), 1)
        # no ordinary kind is less likely than any string, so what isn't above the threshold by that alone isn't by all
        n = len(self.credential)
        most = (self.after[:, :n] - self.after[:, -1:]).max(0)
        usual = self._any(data)
        ahead = like - usual(starts[first][of], to)
        good = np.flatnonzero(ahead[item] + likes[c, kind[item]] - likes[c, -1] + most[kind[item]] > self.threshold)
        held = np.bincount(of_pair[good], minlength=pairs.size)
        where = np.concatenate([[0], np.cumsum(held)])
        occurs = np.flatnonzero(held[pair] > 0)
        times = held[pair[occurs]]
        place = some[np.repeat(occurs, times)]
        item = item[good[np.arange(place.size) - np.repeat(np.cumsum(times) - times, times) + np.repeat(where[pair[occurs]], times)]]
        beyond = starts[place] + to[item] - starts[first][of[item]]
        found = [(rows[place], starts[place], beyond, *self._scored(data, off, rows[place], starts[place], beyond, item, context[place], kind, like, likes, of_bytes))]
        found.append(blocks)
        rows, a, b, k, score = (np.concatenate([np.asarray(f[i]) for f in found]) for i in range(5))
        hit = np.flatnonzero(score > self.threshold)
        rows, a, b, k, score = rows[hit], a[hit], b[hit], k[hit], score[hit]
        taken, chosen = np.zeros(data.size, bool), []
        for j in np.lexsort((k, b, a, -score)):
            if not taken[a[j] : b[j]].any():
                taken[a[j] : b[j]] = True
                chosen.append(j)
        chosen = np.array(sorted(chosen, key=lambda j: a[j]), np.int64)
        rows, a, b, k, score = rows[chosen], a[chosen], b[chosen], k[chosen], score[chosen]
        return rows, a - off[rows], b - off[rows], k, score

    def _after(self, off: np.ndarray, data: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        inside = at < off[rows + 1]
        return np.where(inside, data[np.minimum(at, data.size - 1)].astype(np.int64), 256)

    def _any(self, data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Function of the log-likelihood of each ``data[start:end]`` as any ordinary string, from sums over all places."""
        m = self.ordinary
        state = m.to[m.start[-1], data]
        step = np.where(RUN[data], m.log[m.start[-1], data], 0.0)
        go = np.zeros(data.size)
        both = np.flatnonzero(RUN[data[1:]] & RUN[data[:-1]]) + 1
        go[both] = m.log[state[both - 1], data[both]]
        total = np.cumsum(go)
        return lambda a, b: step[a] + total[b - 1] - total[a] + m.end[state[b - 1]]

    def _scored(self, data, off, rows, starts, ends, item, context, kind, like, likes, of_bytes) -> tuple[np.ndarray, np.ndarray]:
        """Format and score of every place; equal strings in equal contexts are scored once."""
        if not item.size:
            return np.zeros(0, np.int64), np.zeros(0)
        _, one, spelled = np.unique(of_bytes(starts, ends), return_index=True, return_inverse=True)
        usual = self.ordinary.whole(data, starts[one], ends[one])
        f = self._after(off, data, rows, ends)
        key, first, which = np.unique((spelled * np.int64(len(likes)) + context) * 257 + f, return_index=True, return_inverse=True)
        n = len(self.credential)
        theirs = (usual[spelled[first]] + likes[context[first], n:] + self.after[f[first], n:]).max(1)
        k = kind[item]
        return k, like[item] + likes[context, k] + self.after[f, k] - theirs[which]

    def _armoured(self, off, data, words, of_bytes) -> tuple[np.ndarray, ...]:
        """Row, first and last byte, format and score of the bodies of armoured blocks, line breaks left out."""
        found, bodies, text = [], [], data.tobytes()
        at = text.find(b"-----BEGIN ")
        while at >= 0:
            row = int(np.searchsorted(off, at, "right")) - 1
            m = ARMOUR.match(text, at, int(off[row + 1]))
            if m:
                found.append((row, m.start(1), m.end(1)))
                bodies.append(BREAKS.sub(b"", m.group(1)))
            at = text.find(b"-----BEGIN ", at + 1)
        if not found:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0),)
        rows, a, b = np.array(found, np.int64).T
        inner_off, inner = raw(pa.array([x.decode() for x in bodies]))
        k, score = self.score(inner, inner_off[:-1], inner_off[1:], surroundings(off, rows, a, np.searchsorted(words[1], a, "right") - 1, words, of_bytes), self._after(off, data, rows, b))
        return rows, a, b, k, score

    def score(self, data, starts, ends, places, after) -> tuple[np.ndarray, np.ndarray]:
        """Best format and its score of each whole ``data[start:end]``."""
        which, likes = self._context(places)
        total = likes[which] + self.after[after]
        n = len(self.credential)
        mine = self.credential.whole(data, starts, ends) + total[:, :n]
        return mine.argmax(1), mine.max(1) - (self.ordinary.whole(data, starts, ends) + total[:, n:]).max(1)


def _usable(rows: list[Row], sample: int) -> dict[tuple[str, bool], list[Row]]:
    by: dict[tuple[str, bool], list[Row]] = defaultdict(list)
    for r in rows:
        if r[1] and r[3] is not None and r[4] is not None and len(r[1]) <= VALUE_BYTES and r[1].isascii() and all(RUN[ord(c)] for c in r[1]) and len(by[r[3], bool(r[4])]) < sample:
            by[r[3], bool(r[4])].append((r[0] or "", r[1], r[2] or "", r[3], bool(r[4])))
    return {k: v for k, v in by.items() if v}


def hash_of(row: Row) -> str:
    return hashlib.md5("\0".join(row[:3]).encode()).hexdigest()


def train(labelled: list[Row], sample: int = SAMPLE) -> Scanner:
    """Automata and surroundings of each kind, and the threshold between credentials and ordinary strings."""
    by = _usable(labelled, sample)
    names = sorted(k for k, secret in by if secret)
    parts = [(r[0] + r[1][: m.start()], m.group(), r[1][m.end() :] + r[2], "", False) for k, v in by.items() if not k[1] for r in v for m in [*re.finditer(r"[0-9A-Za-z]+", r[1])][:4] if m.group() != r[1]]
    if parts:
        by["", False] = [p for _, p in sorted((hash_of(p), p) for p in parts)[:sample]]
    usual = sorted(k for k, secret in by if not secret)
    groups = [by[k, True] for k in names] + [by[k, False] for k in usual]
    scanner = Scanner(names, Machine([Automaton([r[1] for r in by[k, True]]) for k in names]), Machine([*(Automaton([r[1] for r in by[k, False]]) for k in usual), any_string([r[1] for k in usual for r in by[k, False]])]))
    if not names:
        return scanner
    rows = [r for g in groups for r in g]
    kind = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    off, data = raw(pa.array(["".join(r[:3]) for r in rows]))
    starts = off[:-1] + np.array([len(r[0].encode()) for r in rows])
    ends = starts + np.array([len(r[1]) for r in rows])
    ws, we, _ = spans(off, data)
    place = np.arange(len(rows))
    places = surroundings(off, place, starts, np.searchsorted(we, starts, "right") - 1, (ws, we, hasher(LOWERED[data])(ws, we)), hasher(data))
    after = scanner._after(off, data, place, ends)
    kinds = len(groups) + 1
    for h in places:
        value, times = np.unique(h[h != 0], return_counts=True)
        known = value[times >= SEEN]
        at = np.minimum(np.searchsorted(known, h), max(known.size - 1, 0))
        code = np.where(h == U64(0), NONE, np.where(known[at] == h, at + 2, UNKNOWN)) if known.size else np.where(h == U64(0), NONE, UNKNOWN)
        scanner.known.append(known)
        scanner.around.append(_frequencies(code, kind, known.size + 2, kinds, len(names)))
    scanner.after = _frequencies(after, kind, 257, kinds, len(names))
    found = scanner.score(data, starts, ends, places, after)[1]
    secret = kind < len(names)
    low = np.quantile(found[secret], 0.01, method="lower")
    high = max(low - 20.0, np.quantile(found[~secret], 0.999, method="higher") if (~secret).any() else -np.inf)
    scanner.threshold = float((low + high) / 2 if high < low else max(high, 0.0))
    return scanner


def _frequencies(code: np.ndarray, kind: np.ndarray, values: int, kinds: int, credentials: int) -> np.ndarray:
    """Log-frequency of each value by kind; the last kind, any ordinary string, has those of all ordinary rows."""
    times = np.zeros((values, kinds))
    np.add.at(times, (code, kind), 1.0)
    times[:, -1] = times[:, credentials:-1].sum(1)
    times += 20 * (times.sum(1, keepdims=True) + 0.5) / (times.sum() + 0.5 * values) + 0.02
    return np.log(times / times.sum(0))


def scanned(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """A row for each secret: ``doc_id``, ``byte_start``, ``byte_length``, ``format``, ``score`` and its MD5, not itself."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows, a, b, k, score = sent.value.find(part["text"])
                off, data = raw(part["text"])
                digest = [hashlib.md5(data[off[r] + x : off[r] + y].tobytes()).hexdigest() for r, x, y in zip(rows, a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(rows)), pa.array(a), pa.array(b - a), pa.array([sent.value.names[i] for i in k], pa.string()), pa.array(score), pa.array(digest, pa.string())], ["doc_id", "byte_start", "byte_length", "format", "score", "secret_md5"])

    return slim(docs).mapInArrow(run, "doc_id bigint, byte_start bigint, byte_length bigint, format string, score double, secret_md5 string")


def redact(texts: pa.Array, scanner: Scanner) -> tuple[pa.Array, bool]:
    """The texts with each secret replaced, and whether there was any."""
    rows, a, b, _, _ = scanner.find(texts)
    if not rows.size:
        return texts, False
    off, data = raw(texts)
    mark = np.frombuffer(REDACTED.encode(), np.uint8)
    a, b = a + off[rows], b + off[rows]
    pieces, at = [], 0
    for x, y in zip(a, b, strict=True):
        pieces += [data[at:x], mark]
        at = y
    pieces.append(data[at:])
    change = np.zeros(len(off), np.int64)
    np.add.at(change, rows + 1, mark.size - (b - a))
    made = strings(off + np.cumsum(change), np.concatenate(pieces))
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), made), True


def redacted(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """All columns of ``docs``, secrets in ``text`` replaced by REDACTED and ``n_chars`` made to fit."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at):
                text, any_ = redact(part.column(at).cast(pa.string()), sent.value)
                if not any_:
                    yield part
                    continue
                columns = list(part.columns)
                if chars is not None:
                    changed = pc.fill_null(pc.not_equal(text, columns[at].cast(pa.string())), False)
                    columns[chars] = pc.if_else(changed, pc.utf8_length(text).cast(columns[chars].type), columns[chars])
                columns[at] = text.cast(part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return rows_mapped(docs, run)


def scanner(labelled: DataFrame | None = None, sample: int = SAMPLE) -> Scanner:
    """The scanner of a labelled table, or of the labelled set of this subpackage."""
    if labelled is None:
        return train(labelled_credentials(), sample)
    own = labelled.select("before", "value", "after", "kind", F.col("secret").cast("boolean").alias("secret")).filter(F.length("value").between(1, VALUE_BYTES) & F.col("kind").isNotNull() & F.col("secret").isNotNull())
    order = [F.xxhash64("before", "value", "after"), F.col("value"), F.col("before"), F.col("after")]
    few = own.withColumn("i", F.row_number().over(Window.partitionBy("kind", "secret").orderBy(*order))).filter(F.col("i") <= sample)
    return train([tuple(r) for r in few.orderBy("kind", "secret", "i").drop("i").collect()], sample)
