"""Secret scan: fixed patterns plus a linear-chain conditional random field.

A text is cut into words, numbers and single signs. The field tags each token B
(a secret begins), I (inside) or O (outside) from its shape, the run of glued
tokens it is part of, the tokens beside it, hint words before it and a feature
of the file, and from the tag before; Viterbi finds the best tags of a whole
chain. A secret is a B with the I that follow: a key is many tokens here, and so
are dotted tokens, passwords with signs, phrases and the lines of a key block.

A whole text is one chain: every token is scored, wherever it stands. Features
and scores of all tokens come from numpy at once. Most tokens of prose are
outside beyond doubt: a bound shows that no path that leaves O there can be the
best one (``outside``). So Viterbi runs between them and gives the best tags of
the whole text, not nearly the best.

The field is trained here, on sentences that a fixed rule writes
(``labelled_rows``); weights come from full-batch gradient steps (Adam) on the exact
log-likelihood of emissions and transitions, so every run gets the same ones.
The only fixed weight is that I never begins a chain or follows O.

Cases: null or empty text has no spans. Spans of the field that overlap a
pattern span are left out; pattern spans always stay. Repeated rows give equal
results. Patterns and tokens are found in linear time on whole texts.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import map_texts


def either(word: str) -> str:
    """ASCII letters of ``word`` in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
ASSIGN = re.compile(rf"""(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: Words that speak for a secret close behind them, and words that speak against one.
HINTS = set("password passwd passphrase passcode pass pwd secret token key apikey credential credentials auth authorization bearer private login begin signature".split())
DULL = set("commit sha md5 checksum digest build version release uuid guid id order invoice ref http https file path page ip date phone tel host user email mail see".split())
ANCHOR = re.compile(r"(?i)(?<![a-z])(?:" + "|".join(sorted(HINTS)) + r")(?![a-z])")
LONGEST = 13  # letters, of a hint or dull word: a number in base 27 holds that many

SCHEMA = T.StructType([*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])
B, I, O = range(3)
SPACE, LETTERS, DIGITS, FOREIGN, SIGN = range(5)
#: Kind of each ASCII sign, and of any other one last.
SORTS = np.array([SPACE if chr(k).isspace() else LETTERS if chr(k).isalpha() else DIGITS if chr(k).isdigit() else SIGN for k in range(128)] + [FOREIGN], np.uint8)
UPPER, VOWEL = (np.array([chr(k) in chars for k in range(129)]) for chars in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiouyAEIOUY"))
LETTER = np.array([ord(chr(k).lower()) - 96 if chr(k).isalpha() else 0 for k in range(128)] + [0], np.int64)
POWERS = 27 ** np.arange(LONGEST)
#: Shapes are 0 to 5, then the signs by code; one more is the edge of the text.
S_DIGITS, S_FOREIGN, S_LOWER, S_UPPER, S_TITLE, S_MIXED, S_SIGN = range(7)
EDGE = S_SIGN + 128
START, GLUED, LINE, SPACED = range(4)
#: Features of a token, and how many values each has. Their weights follow one another.
VALUES = {
    "bias": 1, "file": 2, "kind": 8, "size": 8, "many": 8, "kind size": 64, "gap": 4, "shape": EDGE, "len": 8, "near": 3, "near kind": 24,
    "wordlike": 2, "known": 2, "before": (EDGE + 1) * 4, "after": (EDGE + 1) * 4, "before2": EDGE,
}
FIRST = dict(zip(VALUES, np.cumsum([0, *VALUES.values()]).tolist(), strict=False))
NONE = sum(VALUES.values())  # the feature that weighs nothing
Token = tuple[int, int, tuple[int, ...]]


def bucket(n: np.ndarray) -> np.ndarray:
    """0 to 7 for the largest of 0, 1, 2, 3, 5, 9, 17 and 33 that n reaches."""
    return np.searchsorted([1, 2, 3, 5, 9, 17, 33], n, side="right")


def packed_words(words: set[str]) -> np.ndarray:
    return np.array(sorted(sum((ord(c) - 96) * 27**k for k, c in enumerate(w)) for w in words if w.isalpha()), np.int64)


PACKED = packed_words(HINTS), packed_words(DULL)


def within(marks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of ``marks`` hold in each range."""
    sums = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=sums[1:])
    return sums[high] - sums[low]


def stretches(text: str) -> list[tuple[int, int]]:
    """Start and end of the parts of ``text`` that are chains: all of it."""
    return [(0, len(text))] if text else []


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts and ends of all tokens of ``text``, and for each of VALUES the feature numbers of the tokens."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128).astype(np.uint8)
    sorts = SORTS[codes]
    turn = sorts[1:] != sorts[:-1]
    own = sorts == SIGN
    low = np.flatnonzero((sorts != SPACE) & (own | np.r_[True, turn]))
    high = np.flatnonzero((sorts != SPACE) & (own | np.r_[turn, True])) + 1
    n = len(low)
    if not n:
        return low, high, [low] * len(VALUES)
    sort, size = sorts[low], high - low
    letters, sign = sort == LETTERS, sort == SIGN
    upper = UPPER[codes]
    uppers = within(upper, low, high)
    shape = np.select(
        [sign, sort == DIGITS, sort == FOREIGN, uppers == 0, uppers == size, (uppers == 1) & upper[low]],
        [S_SIGN + codes[low].astype(np.int64), S_DIGITS, S_FOREIGN, S_LOWER, S_UPPER, S_TITLE],
        S_MIXED,
    )
    gap = np.full(n, START)
    if n > 1:
        gap[1:] = np.where(low[1:] == high[:-1], GLUED, np.where(within(codes == 10, high[:-1], low[1:]) > 0, LINE, SPACED))
    # Runs of glued tokens.
    head = np.flatnonzero(gap != GLUED)
    tail = np.r_[head[1:], n]
    run = np.repeat(np.arange(len(head)), tail - head)
    a, b = low[head], high[tail - 1]
    rising = np.zeros(len(codes), bool)
    rising[:-1] = (sorts[:-1] == LETTERS) & ~upper[:-1] & upper[1:]
    kinds = np.logical_or.reduceat(letters, head) + 2 * np.logical_or.reduceat(sort == DIGITS, head) + 4 * (within(rising, a, b) > 0)
    kind, run_size, many = kinds[run], bucket(b - a)[run], bucket(tail - head)[run]
    # Words whose vowels and consonants take turns: not more than four consonants in a row.
    vowels = VOWEL[codes]
    consonants = (sorts == LETTERS) & ~vowels
    five = np.zeros(len(codes), bool)
    if len(codes) > 4:
        five[:-4] = consonants[:-4] & consonants[1:-3] & consonants[2:-2] & consonants[3:-1] & consonants[4:]
    share = within(vowels, low, high) / size
    wordlike = np.where((0.2 <= share) & (share <= 0.75) & (within(five, low, high) == 0), 0, 1)
    # Hint (1) and dull (2) words, and the last of them before each token, if at most six words or numbers lie between.
    known = np.zeros(n, np.int64)
    short = np.flatnonzero(letters & (size <= LONGEST))
    at = np.arange(LONGEST)
    spelt = np.where(at < size[short, None], LETTER[codes[np.minimum(low[short, None] + at, len(codes) - 1)]], 0) @ POWERS
    for value, words in enumerate(PACKED, 1):
        place = np.minimum(np.searchsorted(words, spelt), len(words) - 1)
        known[short[words[place] == spelt]] = value
    last = np.r_[-1, np.maximum.accumulate(np.where(known > 0, np.arange(n), -1))[:-1]]
    passed = np.cumsum(~sign & (known == 0))
    since = np.r_[0, passed[:-1]] - passed[last]
    near = np.where((last >= 0) & (since <= 6), known[last], 0)
    config = (text.count("=") + text.count('":') + text.count(";")) * 12 > text.count(" ") + 1
    flat = np.zeros(n, np.int64)
    found = {
        "bias": flat, "file": flat + config, "kind": kind, "size": run_size, "many": many, "kind size": kind * 8 + run_size, "gap": gap, "shape": shape, "len": bucket(size),
        "near": near, "near kind": near * 8 + kind, "wordlike": np.where(letters, wordlike, -1), "known": known - 1,
        "before": np.r_[EDGE, shape[:-1]] * 4 + gap, "after": np.r_[shape[1:], EDGE] * 4 + np.r_[gap[1:], START], "before2": np.r_[[-1] * min(n, 2), shape[:-2]],
    }
    return low, high, [np.where(found[f] < 0, NONE, FIRST[f] + found[f]) for f in VALUES]


def chains(text: str) -> list[list[Token]]:
    """(start, end, feature numbers) of the tokens of each chain."""
    out = []
    for a, b in stretches(text):
        low, high, x = features(text[a:b])
        if len(low):
            out.append(list(zip((low + a).tolist(), (high + a).tolist(), map(tuple, np.stack(x, 1).tolist()), strict=True)))
    return out


def syllables(r: random.Random, low: int, high: int) -> str:
    return "".join(r.choice("bcdfghklmnprstvw") + r.choice(["a", "e", "i", "o", "u", "er", "an", "in", "st"]) for _ in range(r.randint(low, high)))


def labelled_rows(n: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """(text, secret spans): prose and settings with secrets of many tokens and with look-alikes that are none."""
    r = random.Random(seed)
    lower, upper, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: syllables(r, 1, 4)
    foreign = lambda: "".join(r.choice([word(), r.choice("áéíóúñäöüßèêçà")]) for _ in range(r.randint(2, 4)))
    noise = lambda: r.choice([word, word, foreign])() + r.choice([".", ",", "", ""]) + r.choice("!#$%&*~=-_+?") * r.randint(2, 4)
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    both = lower + upper + digits
    bare = [  # known by their look alone
        lambda: pick(hexes, r.randint(24, 64)),
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: pick(both, r.randint(20, 44)),
        lambda: pick(both + "+/", 40) + "=",
        lambda: r.choice(["ghp_", "sk_live_", "pk-", "glpat-"]) + pick(both, r.randint(24, 36)),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(both, 24),
        lambda: "eyJ" + pick(both, 24) + "." + pick(both, 30) + "." + pick(both + "_-", 30),
    ]
    weak = [  # known by the words before them
        lambda: pick(lower + digits, r.randint(8, 14)) + pick(digits, 2),
        lambda: word().title() + r.choice("!@#$%&*") + pick(digits, r.randint(2, 4)),
        lambda: word() + r.choice("-_.") + word() + r.choice("-_.!") + pick(digits, 2),
        lambda: "-".join(word() for _ in range(r.randint(3, 5))),
        lambda: pick(both + "!@#$%^&*", r.randint(10, 18)),
    ]
    alike = [
        lambda: f"{word()}{r.randint(10, 99)}.{word()}",
        lambda: f"2{pick(digits, 3)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}",
        lambda: f"v{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(0, 99)}-beta{r.randint(1, 9)}",
        lambda: f"/{word()}/{word()}{r.randint(1, 9)}/{word()}.html",
        lambda: f"https://{word()}{r.randint(1, 9)}.com/{word()}/{word()}?{word()}={r.randint(1, 99)}",
        lambda: f"{pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}",
        lambda: f"{word().title()}{word().title()}{word().title()}",
        lambda: f"{word()}_{word()}_{r.randint(1, 99)}",
        lambda: f"{word()}.{word()}{r.randint(1, 99)}@{word()}.com",
        lambda: f"{r.randint(100, 999)}x{r.randint(100, 999)}px",
        lambda: f"{word()}-{word()}-{word()}",
        lambda: f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}:{r.randint(1000, 9999)}",
    ]
    out = []
    for k in range(n):
        text, spans = words(1, 8) + " ", []

        def put(head: str, value: str, tail: str = "") -> None:
            nonlocal text
            spans.append((len(text) + len(head), len(text) + len(head) + len(value)))
            text += head + value + tail

        for _ in range(r.randint(1, 3)):
            sort, quote = r.random(), r.choice(["", "", '"', "'"])
            if sort < 0.2:
                put(r.choice(["", "", "key = ", "auth: ", "Bearer ", "credential=", "private key: ", "Authorization: Bearer "]) + quote, r.choice(bare)(), quote)
            elif sort < 0.32:
                put(r.choice(["pwd=", "pwd: ", "pass: ", "passphrase is ", "login/password ", "auth_key=", "credential: ", "my pass is "]) + quote, r.choice(weak)(), quote)
            elif sort < 0.38:
                put(r.choice(["passphrase: ", "passphrase = ", "passphrase is "]) + '"', " ".join(word() for _ in range(r.randint(4, 6))), '"')
            elif sort < 0.42:
                put(r.choice(["app pass: ", "login key: ", "pwd: "]), " ".join(pick(lower, 4) for _ in range(4)), "\n")
            elif sort < 0.48:
                put(f"{word()}://{word()}:", r.choice(weak[:2] + weak[4:])().replace("@", "!"), f"@{word()}.{word()}:{r.randint(1000, 9999)}/{word()}")
            elif sort < 0.54:
                put("\n-----BEGIN PRIVATE KEY-----\n", "\n".join(pick(both + "+/", 32) for _ in range(r.randint(2, 4))), "\n-----END PRIVATE KEY-----\n")
            elif sort < 0.66:
                text += r.choice(["commit ", "build ", "version: ", "uuid=", "id=", "file ", "order #", "path=", "ref: ", "checksum ", "see "]) + quote + r.choice([lambda: pick(hexes, r.choice([8, 12, 20, 40])), *alike])() + quote
            elif sort < 0.78:
                text += r.choice(["the password page", "a secret of " + word(), "the key to " + word(), "this token was lost", "pass the " + word(), "auth failed for " + word(), "login page: " + word(), "private matters", "the passphrase is long", "key: value", "begin with " + word(), "key findings: " + words(2, 4), "reset your password at " + r.choice(alike[3:5])()])
            else:
                text += r.choice(["", "", "", '"', "= "]) + r.choice(alike)()
            text += r.choice([" ", " ", "\n", ". ", ", ", "; "]) + words(1, 6) + " "
        if k % 4 == 1:  # prose of other letters, and with signs behind its words
            text += " ".join(r.choice([word, foreign, foreign, noise])().capitalize() if r.random() < 0.2 else r.choice([word, foreign, foreign, noise])() for _ in range(r.randint(5, 25))) + r.choice([" ", ".\n"])
        out.append((text + (";\n" + "a = 1; " * r.randint(2, 9) if k % 3 == 0 else ""), spans))
    return out


def tagged(tokens: list[Token], spans: list[tuple[int, int]]) -> list[int]:
    tags = []
    for a, _, _ in tokens:
        span = next((s for s in spans if s[0] <= a < s[1]), None)
        tags.append(O if span is None else B if a == span[0] else I)
    return tags


Model = tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]
NEVER = -30.0


@lru_cache(maxsize=1)
def trained(steps: int = 300, rate: float = 0.05, decay: float = 2e-5) -> Model:
    """First number of each feature, emission weights (feature number, tag), transition weights (tag, tag) and start weights."""
    rows = [(c, tagged(c, spans)) for text, spans in labelled_rows() for c in chains(text)]
    rows = sorted(((c, t) for c, t in rows if t[0] != I), key=lambda row: -len(row[1]))  # so that live rows come first
    length, n = max(len(t) for _, t in rows), len(rows)
    live = np.zeros((n, length), bool)
    y = np.zeros((n, length), int)
    for k, (_, t) in enumerate(rows):
        live[k, : len(t)], y[k, : len(t)] = True, t
    x = np.array([numbers for c, _ in rows for _, _, numbers in c])
    wanted = np.eye(3)[y] * live[:, :, None]
    pairs = live[:, 1:]  # live is a run from the start of each row
    lives, row_of, pair_of = live.sum(0).tolist(), np.nonzero(live)[0], np.nonzero(pairs)[0]
    turns_wanted = np.einsum("nta,ntb->ab", wanted[:, :-1] * pairs[:, :, None], wanted[:, 1:])
    emit, move, start = np.zeros((NONE + 1, 3)), np.zeros((3, 3)), np.array([0.0, NEVER, 0.0])
    move[O, I] = NEVER
    free = move > NEVER
    means, squares = ([np.zeros_like(w) for w in (emit, move)] for _ in range(2))
    scores = np.zeros((n, length, 3))
    for step in range(1, steps + 1):
        scores[live] = emit[x].sum(1)
        ahead, back = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = start + scores[:, 0]
        for t, m in enumerate(lives[1:], 1):
            ahead[:m, t] = total(ahead[:m, t - 1, :, None] + move, 1) + scores[:m, t]
        for t, m in reversed(list(enumerate(lives[1:]))):
            back[:m, t] = total(move + (scores[:m, t + 1] + back[:m, t + 1])[:, None, :], 2)
        whole = total(ahead[:, 0] + back[:, 0], 1)
        chance = np.exp((ahead + back)[live] - whole[row_of, None])
        turn = np.exp(ahead[:, :-1][pairs][:, :, None] + move + (scores[:, 1:] + back[:, 1:])[pairs][:, None, :] - whole[pair_of, None, None])
        gap = np.repeat(wanted[live] - chance, len(VALUES), axis=0)
        slope = np.stack([np.bincount(x.ravel(), gap[:, t], NONE + 1) for t in range(3)], 1)
        slope[-1] = 0
        for w, g, mean, square, on in ((emit, slope / n - decay * emit, means[0], squares[0], True), (move, (turns_wanted - turn.sum(0)) / n, means[1], squares[1], free)):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            w += np.where(on, rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-5), 0)
    return FIRST, emit, move, start


def total(a: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = a.max(axis, keepdims=True)
    return top.squeeze(axis) + np.log(np.exp(a - top).sum(axis))


def viterbi(scores: np.ndarray, move: np.ndarray, start: np.ndarray) -> list[int]:
    moves = move.T.tolist()
    rows = scores.tolist()
    best, back = [s + e for s, e in zip(start.tolist(), rows[0], strict=True)], []
    for row in rows[1:]:
        step, now = [], []
        for into, e in zip(moves, row, strict=True):
            x, y, z = best[0] + into[0], best[1] + into[1], best[2] + into[2]
            k = 0 if x >= y and x >= z else 1 if y >= z else 2
            step.append(k)
            now.append((x, y, z)[k] + e)
        back.append(step)
        best = now
    tags = [best.index(max(best))]
    for step in reversed(back):
        tags.append(step[tags[-1]])
    return tags[::-1]


def outside(scores: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Tokens that the best path tags O for certain.

    A path leaves O for a B, goes on with B or I, and comes back. Here is the most
    that any such way through a token can score above the same way all in O; where
    that is below 0, the best path has none.
    """
    over = move - move[O, O]
    gain = scores - scores[:, O, None]
    enter = np.maximum(gain[:, B] + over[O, B], gain[:, I] + over[O, I])
    enter[0] = max(gain[0, B] + start[B] - start[O], gain[0, I] + start[I] - start[O])
    inside = np.maximum(gain[:, B] + over[[B, I], B].max(), gain[:, I] + over[[B, I], I].max())
    sums = np.cumsum(inside)
    left = np.maximum.accumulate(enter - sums)  # entered at this token or before
    right = np.maximum.accumulate(sums[::-1])[::-1]  # left O until some token from here on
    return left + right + max(0.0, over[B, O], over[I, O]) < -1e-6


def best_tags(scores: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The tags of the best path: Viterbi between the tokens that are O for certain."""
    tags = np.full(len(scores), O)
    edge = np.diff(np.r_[False, ~outside(scores, move, start), False].astype(np.int8))
    for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
        part = scores[a:b].copy()
        if b < len(scores):
            part[-1] += move[:, O]
        tags[a:b] = viterbi(part, move, move[O] if a else start)
    return tags


def crf_spans(text: str, model: Model) -> list[tuple[int, int]]:
    _, emit, move, start = model
    low, high, x = features(text)
    if not len(low):
        return []
    scores = np.zeros((len(low), 3))
    for numbers in x:
        scores += emit[numbers]
    tags = best_tags(scores, move, start)
    out: list[list[int]] = []
    for k in np.flatnonzero(tags != O).tolist():
        if tags[k] == B:
            out.append([int(low[k]), int(high[k])])
        elif out:
            out[-1][1] = int(high[k])
    return [(a, b) for a, b in out]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if ":" in text or "=" in text else []
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a count for each kind, ``base_spans`` and ``spans`` (kind:start:end by start, then kind; code points, end exclusive)."""
    model = trained()

    def run(texts: list[str]) -> list:
        columns: list[list] = [[] for _ in SCHEMA.fields]
        for t in texts:
            base = base_spans(t)
            more = [(a, b, "crf") for a, b in crf_spans(t, model) if not any(a < y and x < b for x, y, _ in base)]
            spans = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
            told = [",".join(f"{k}:{a}:{b}" for a, b, k in x) for x in (base, spans)]
            for c, v in zip(columns, [*(sum(s[2] == k for s in spans) for k in KINDS), *told], strict=True):
                c.append(v)
        return columns

    return map_texts(df, id_col, text_col, SCHEMA, lambda: run)
