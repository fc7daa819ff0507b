"""Personal data: fixed patterns, and spans added by linear-chain conditional random fields.

A field labels blank-delimited tokens of a line from word-shape features of a
token and its neighbours: one with O, email, ip, card or phone, a second one
with O or secret (keys, tokens, passwords), whose spans may not overlap the
others.  Both are trained here on small labelled tables by exact gradients
(forward-backward) and decoded by Viterbi over numpy batches of lines.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, bounded_batches, text_slices

KINDS = ("email", "ip", "card", "phone")
#: The kinds in the order that spans are listed in; fixed patterns find the first four.
ALL_KINDS = (*KINDS, "secret")
LABELS, SECRET_LABELS = ("O", *KINDS), ("O", "secret")
#: Cells (lines x tokens) that Viterbi decodes at once; a longer line is decoded alone.
VITERBI_CELLS = 1 << 17

# The base patterns of the contract.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
#   card  [0-9]([\x20-]?[0-9])+, 16 to 19 digits passing Luhn
#   phone \+[0-9][\x20().0-9-]+[0-9], 8 to 15 digits
# Below they are written so that no text takes quadratic time: runs are
# possessive, and an address is found from its @ backwards.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_REPEATED = re.compile(r"(.{1,12}?)\1{8,}")
#: A token without any of these is plain.
_TELLING = re.compile(r"[0-9@:]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        step = at + 1
        if m:
            start = at
            while start > last and _LOCAL.fullmatch(text[start - 1]):
                start -= 1
            if start < at:
                yield start, m.end()
                last = step = m.end()
        else:
            # a run cannot pass this @, so nothing before it can match later
            last = max(last, step)
        at = text.find("@", step)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def shape(token: str) -> str:
    """Word shape: runs of letters as A or a, digits as 9 with the run's length, other characters as they are.

    The whole token counts; in a shape over 80 long, what repeats more than eight times on end is kept eight times.
    """
    out = []
    for run in re.finditer(r"[0-9]+|[^\W\d_]+|[^0-9]", token, re.UNICODE):
        s = run[0]
        if s[0] in "0123456789":
            out.append(f"9{min(len(s), 20)}")
        elif s[0].isalpha():
            out.append("A" if s[0].isupper() else "a")
        else:
            out.append(s if ord(s) < 128 else "u")
    whole = "".join(out)
    return whole if len(whole) <= 80 else _REPEATED.sub(lambda m: m[1] * 8, whole)


def token_features(token: str) -> tuple[list[str], str]:
    """Features of the token itself, and the coarse class that its neighbours see."""
    core = token.strip(".,;:!?\"'|*$%&#")
    s = shape(core)
    digits = sum(c in "0123456789" for c in core)
    if not digits and "@" not in core and ":" not in core:
        return ["plain"], "word" if core.isalpha() else "mark"
    own = [f"shape={s}", f"kinds={re.sub('[0-9]+', '', s)[:12]}", f"digits={min(digits, 20)}"]
    own += [f"has{c}" for c in "@.:-()+/" if c in core]
    if core[:1] in "+(":
        own.append(f"first{core[0]}")
    letters = any(c.isalpha() for c in core)
    own.append(f"letters={letters}")
    if "@" in core:
        coarse = "at"
    elif letters:
        coarse = "mixed"
    else:
        coarse = f"num{min(digits, 5)}{'(' if '(' in core else ''}{'+' if '+' in core else ''}{'.' if '.' in core else ''}"
    return own, coarse


def labelled_table(sentences: int = 240, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (token, label), made from templates.

    Beside the base forms it holds forms that only the field finds (phone
    numbers without +, grouped with - or ., IPv6, cards with dots) and numbers
    that are none of these (dates, times, prices, versions, serial numbers).
    """
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["er", "on", "the", "ou", "lich", "ción", "eau", "st", "ra", "in"]) for _ in range(r.randint(1, 4)))

    def entity():
        k = r.randrange(9)
        name, host = f"{word()}.{n(2)}", f"mail{n(1)}.{r.choice(['example', word()])}.{r.choice(['com', 'org', 'net'])}"
        if k <= 1:
            return [(f"{name}@{host}", "email")]
        if k == 2:
            return [(".".join(str(r.randint(0, 255)) for _ in range(4)), "ip")]
        if k == 3:
            return [(":".join("".join(r.choice("0123456789abcdef") for _ in range(4)) for _ in range(8)), "ip")]
        if k == 4:
            return [(n(16), "card")]
        if k == 5:
            return [(n(4), "card") for _ in range(4)] if r.random() < 0.5 else [(r.choice("-.").join(n(4) for _ in range(4)), "card")]
        if k == 6:
            return [("+1", "phone"), (f"({n(3)})", "phone"), (f"{n(3)}-{n(4)}", "phone")]
        if k == 7:
            return [(f"({n(3)})", "phone"), (f"{n(3)}-{n(4)}", "phone")]
        return [(r.choice("-.").join((n(3), n(3), n(4))), "phone")]

    def other():
        k = r.randrange(10)
        plain = [f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", f"{n(2)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", n(r.randint(1, 6)), f"{word()}{n(3)}", f"{n(3)}%", f"#{n(5)}", f"{n(8)}{word()}{n(5)}", f"{n(2)}/{n(2)}"]
        return [(plain[k], "O")]

    table = []
    for _ in range(sentences):
        row = []
        for _ in range(r.randint(1, 4)):
            row += [(word().capitalize() if r.random() < 0.2 else word(), "O") for _ in range(r.randint(0, 5))]
            row += entity() if r.random() < 0.6 else other()
        row += [(word(), "O") for _ in range(r.randint(1, 4))]
        if r.random() < 0.4:
            row[-1] = (row[-1][0] + ".", row[-1][1])
        table.append(row)
    return table


#: Words beside which a long mixed token is a secret, and those beside which it is a public digest or name.
CUES = ("token", "key", "secret", "password", "passwd", "pwd", "bearer", "credential", "auth", "apikey")
PUBLIC_CUES = ("commit", "sha", "md5", "digest", "checksum", "uuid", "etag", "hash", "build", "version", "revision")
_VALUE = re.compile(r"[A-Za-z0-9+/_.~-]{16,}={0,2}")
_PART_WORD = re.compile(r"[a-z]+")


def _value_of(token: str) -> tuple[int, int] | None:
    """Where a token's long mixed value is (letters and digits, 16 characters or more): the last such run after = or :, else None."""
    for m in reversed(list(_VALUE.finditer(token))):
        run = m[0]
        if "://" not in token and any(c in "0123456789" for c in run) and any(c.isalpha() for c in run):
            return m.span()
    return None


def secret_features(token: str) -> tuple[list[str], str]:
    """As :func:`token_features`, for the field of secrets."""
    at = _value_of(token) if len(token) >= 16 else None
    words = set(_PART_WORD.findall(token[: at[0]].lower() if at else token.lower())) if at or len(token) <= 40 else set()
    cue = "cue" if words & set(CUES) else "public" if words & set(PUBLIC_CUES) else ""
    if at is None:
        if cue:
            return ["cue:" + cue], cue
        if "@" in token or "/" in token:
            return ["address"], "address"
        return ["other"], "mark" if not any(c.isalnum() for c in token) else "other"
    run = token[at[0] : at[1]]
    digits = sum(c in "0123456789" for c in run)
    letters = {c.lower() for c in run if c.isalpha()}
    own = ["value", f"hex={letters <= set('abcdef')}", f"long={min(len(run) // 8, 8)}", f"digits={10 * digits // len(run)}", f"case={any(c.isupper() for c in run) + 2 * any(c.islower() for c in run)}", f"inside={cue}"]
    own += [f"has{c}" for c in "./_-+~" if c in run]
    own += [f"at{c}" for c in "@/" if c in token[: at[0]] + token[at[1] :]]
    own += [f"starts={run[:4].lower()}"] if run[:4].lower() in ("akia", "ghp_", "sk-l", "sk_l", "xoxb", "eyjh") else []
    return own, "value"


def secret_table(sentences: int = 300, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The labelled table of secrets: assignments and bearer lines, beside digests, names, addresses and numbers that are none."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    lower, upper, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = lambda k: pick("0123456789abcdef", k)
    word = lambda: "".join(r.choice(["er", "on", "the", "ou", "lich", "ción", "eau", "st", "ra", "in"]) for _ in range(r.randint(1, 4)))

    def value():
        return r.choice([hexa(32), hexa(40), hexa(40).upper(), hexa(64), pick(lower + upper + num, r.randint(20, 48)), pick(lower + upper + num + "+/", 44) + "=", "sk-l" + pick(lower + num, 32)])

    def secret():
        cue = r.choice([*CUES, "api_key", "access_token", "client_secret", "x-api-key", "auth_token"])
        cue = cue.upper() if r.random() < 0.3 else cue
        k, v = r.randrange(6), value()
        if k <= 1:
            return [(cue, "O"), ("=", "O"), (f'"{v}"', "secret")]
        if k == 2:
            return [(cue + ":", "O"), (v, "secret")]
        if k == 3:
            return [(f"{cue}={v}", "secret")]
        if k == 4:
            return [("Authorization:", "O"), ("Bearer", "O"), (v, "secret")]
        return [(r.choice(["AKIA" + pick(upper + num, 16), "ghp_" + pick(lower + upper + num, 36)]), "secret")]

    def other():
        k, public = r.randrange(10), r.choice(PUBLIC_CUES)
        if k <= 1:
            return [(public, "O"), (r.choice([hexa(40), hexa(64), hexa(32)]), "O")]
        if k == 2:
            return [(public, "O"), ("=", "O"), (f'"{hexa(40)}"', "O")]
        if k == 3:
            return [(f"{public}={hexa(40)}", "O")]
        if k == 4:
            return [(r.choice([hexa(40), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"]), "O")]
        if k == 5:
            return [(f"{word()}.{pick(num, 2)}@mail{pick(num, 1)}.{word()}.com", "O")]
        if k == 6:
            return [(f"https://www.{word()}.com/{word()}/{pick(num, 8)}/{word()}-{word()}-{word()}", "O")]
        if k == 7:
            return [(f"{word()}_{pick(num, 8)}_{pick(num, 6)}_{word()}.jpg", "O")]
        if k == 8:
            return [(r.choice(CUES), "O"), (r.choice([word(), pick(num, 4), "="]), "O"), (word(), "O")]
        return [(f"20{pick(num, 2)}-{pick(num, 2)}-{pick(num, 2)}T{pick(num, 2)}:{pick(num, 2)}:{pick(num, 2)}Z", "O")]

    table = []
    for _ in range(sentences):
        row = [(word(), "O") for _ in range(r.randint(0, 5))]
        for _ in range(r.randint(1, 3)):
            row += secret() if r.random() < 0.5 else other()
            row += [(word(), "O") for _ in range(r.randint(0, 4))]
        table.append(row)
    return table


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Field:
    """features: name -> row of ``weights`` (features x labels); ``moves``: label x label; ``starts``: labels.

    ``of``: token -> (own features, class that its neighbours see).
    """

    features: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    labels: tuple[str, ...] = LABELS
    of: Callable[[str], tuple[list[str], str]] = token_features

    def emission(self, token: str) -> tuple[np.ndarray, str]:
        own, coarse = self.of(token)
        ids = [self.features[f] for f in own if f in self.features]
        return self.weights[ids].sum(0), coarse

    def beside(self, side: str, coarse: str) -> np.ndarray:
        i = self.features.get(side + coarse)
        return self.weights[i] if i is not None else np.zeros(len(self.labels))


#: Neighbours whose classes are features of a token: how they are named, and where they are.
SIDES = (("<", -1), (">", 1))
FAR_SIDES = (*SIDES, ("<<", -2))


def _line_features(tokens: list[str], of=token_features, sides=SIDES) -> list[list[str]]:
    own = [of(t) for t in tokens]
    seen = lambda i: own[i][1] if 0 <= i < len(own) else "edge"
    return [f + [side + seen(i + d) for side, d in sides] for i, (f, _) in enumerate(own)]


def fit(table: list[list[tuple[str, str]]], epochs: int = 120, rate: float = 0.15, ridge: float = 0.02, labels: tuple[str, ...] = LABELS, of=token_features, sides=SIDES) -> Field:
    """Maximum likelihood with a ridge, by Adam on exact gradients."""
    lines = [_line_features([t for t, _ in row], of, sides) for row in table]
    names = {f: i for i, f in enumerate(sorted({f for line in lines for fs in line for f in fs}))}
    size, k, longest = len(lines), len(labels), max(map(len, lines))
    mask = np.zeros((size, longest), bool)
    gold = np.zeros((size, longest), int)
    cell, feat = [], []
    for i, (line, row) in enumerate(zip(lines, table, strict=True)):
        for t, fs in enumerate(line):
            mask[i, t], gold[i, t] = True, labels.index(row[t][1])
            cell += [i * longest + t] * len(fs)
            feat += [names[f] for f in fs]
    cell, feat = np.array(cell), np.array(feat)
    theta = np.zeros((len(names) + k + 1) * k)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    onehot = np.eye(k)[gold] * mask[..., None]
    for step in range(1, epochs + 1):
        w, moves, starts = theta[: len(names) * k].reshape(-1, k), theta[len(names) * k : -k].reshape(k, k), theta[-k:]
        e = np.stack([np.bincount(cell, w[feat, c], size * longest) for c in range(k)], 1).reshape(size, longest, k)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = starts + e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _lse(alpha[:, t - 1, :, None] + moves, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _lse(moves + (e[:, t + 1] + beta[:, t + 1])[:, None], 2), 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        diff = p - onehot
        g_w = np.stack([np.bincount(feat, diff.reshape(-1, k)[cell, c], len(names)) for c in range(k)], 1)
        g_m = np.zeros((k, k))
        for t in range(1, longest):
            q = np.exp(alpha[:, t - 1, :, None] + moves + (e[:, t] + beta[:, t])[:, None] - z[:, None, None]) * mask[:, t, None, None]
            g_m += q.sum(0) - onehot[:, t - 1].T @ onehot[:, t]
        grad = np.concatenate([g_w.ravel(), g_m.ravel(), diff[:, 0].sum(0)]) / size + ridge * theta / size
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(names, theta[: len(names) * k].reshape(-1, k), theta[len(names) * k : -k].reshape(k, k), theta[-k:], labels, of)


def viterbi(lines: list[np.ndarray], moves: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Best label path of each line of emissions (tokens x labels), lines of similar length at once, up to VITERBI_CELLS cells."""
    out: list = [None] * len(lines)
    order, at = sorted(range(len(lines)), key=lambda i: len(lines[i])), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(lines[order[end]]) <= VITERBI_CELLS:
            end += 1
        part, at = order[at:end], end
        longest = len(lines[part[-1]])
        e = np.zeros((len(part), longest, len(starts)))
        size = np.array([len(lines[i]) for i in part])
        for r, i in enumerate(part):
            e[r, : size[r]] = lines[i]
        back = np.zeros(e.shape, np.int8)
        v = starts + e[:, 0]
        rows = np.arange(len(part))
        ends = np.zeros(len(part), int)
        ends[size == 1] = v.argmax(1)[size == 1]
        for t in range(1, longest):
            reach = v[:, :, None] + moves
            back[:, t] = reach.argmax(1)
            v = reach.max(1) + e[:, t]
            ends[size == t + 1] = v.argmax(1)[size == t + 1]
        path = np.zeros((len(part), longest), np.int8)
        now = ends.copy()
        for t in range(longest - 1, -1, -1):
            alive = t < size
            path[alive, t] = now[alive]
            now = np.where(alive & (t > 0), back[rows, t, now], now)
        for r, i in enumerate(part):
            out[i] = path[r, : size[r]]
    return out


def _plausible(kind: str, text: str) -> bool:
    if kind == "secret":
        return _value_of(text) is not None
    digits = len(_DIGITS.sub("", text))
    if kind == "phone":
        return 7 <= digits <= 15 and not any(c.isalpha() for c in text)
    if kind == "card":
        d = _DIGITS.sub("", text)
        return 13 <= digits <= 19 and luhn(d)
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}", text))
    return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", text))


#: Parts of a token that can be numbers of their own; what stands between two of them can end a number.
_PART = re.compile(r"[^\s,;:!?\"'|*$%&#\[\]{}<>/]+")


def _split(kind: str, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Plausible spans of a run of number tokens that is no single number, outside those taken.

    Of all choices of disjoint runs of parts, one that covers most digits; then
    one with fewest commas, brackets or the like inside a span; then the most even.
    """
    found, last = [], 0
    for x, y in [*sorted(taken), (len(text), len(text))]:
        parts = []
        for m in _PART.finditer(text, min(last, x), max(x, 0)):
            core = m[0].rstrip(".")
            n = sum(c in "0123456789" for c in core)
            if n:
                parts.append((m.start() + len(core) - len(core.lstrip(".")), m.start() + len(core), n))
        last = max(last, y)
        ends = [i > 0 and (text[b] in "+(" or not text[parts[i - 1][1] : b].isspace()) for i, (b, _, _) in enumerate(parts)]
        # best[i]: score of the parts from i on, and the end of the run that starts at i (0: none)
        best: list = [((0, 0, 0), 0)] * (len(parts) + 1)
        for i in range(len(parts) - 1, -1, -1):
            best[i] = (best[i + 1][0], 0)
            digits = crossed = 0
            for j in range(i, len(parts)):
                digits += parts[j][2]
                crossed += j > i and ends[j]
                if digits > 19:
                    break
                if _plausible(kind, text[parts[i][0] : parts[j][1]]):
                    rest = best[j + 1][0]
                    score = (rest[0] + digits, rest[1] - crossed, rest[2] - digits * digits)
                    if score > best[i][0]:
                        best[i] = (score, j + 1)
        i = 0
        while i < len(parts):
            if best[i][1]:
                found.append((parts[i][0], parts[best[i][1] - 1][1]))
            i = best[i][1] or i + 1
    return found


class Finder:
    """Spans of texts by a trained field."""

    def __init__(self, field: Field):
        self.field = field
        self.classes: dict[str, int] = {"edge": 0}
        self._clear()
        # A line of plain tokens only: if at every one of them O gains most whatever its neighbours and the labels
        # beside it, the best path is all O, and the line needs no decoding.
        plain = field.emission("a")[0]
        sides = [field.beside("<", x) + field.beside(">", y) for x in ("edge", "word", "mark") for y in ("edge", "word", "mark")]
        lead = max((plain + s - (plain + s)[0])[1:].max() for s in sides)
        step = max((field.moves - field.moves[:1, :1])[:, 1:].max(), (field.starts - field.starts[0])[1:].max(), (field.moves[1:, 0] - field.moves[0, 0]).max())
        self.skip_plain = bool(lead + 2 * max(step, 0.0) <= 0)

    def _clear(self) -> None:
        """Forget all tokens."""
        self.known: dict[str, int] = {}
        self.own, self.kind = np.zeros((1024, len(self.field.labels))), np.zeros(1024, np.int32)

    def _row(self, token: str) -> int:
        at = len(self.known)
        if at == len(self.own):
            self.own, self.kind = np.vstack([self.own, np.zeros_like(self.own)]), np.append(self.kind, np.zeros_like(self.kind))
        self.own[at], coarse = self.field.emission(token)
        self.kind[at] = self.classes.setdefault(coarse, len(self.classes))
        self.known[token] = at
        return at

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Tokens x labels: what a token's own features and its neighbours' classes say."""
        if len(self.known) >= CACHE_WORDS:
            self._clear()
        rows = np.fromiter((self.known[t] if t in self.known else self._row(t) for t in tokens), np.int64, len(tokens))
        kinds = np.zeros(len(tokens) + 4, np.int32)  # two edges on either side
        kinds[2:-2] = self.kind[rows]
        out = self.own[rows]
        for side, d in FAR_SIDES:
            table = np.array([self.field.beside(side, c) for c in self.classes])
            out = out + table[kinds[2 + d : len(kinds) - 2 + d]]
        return out

    def _lines(self, texts: list[str], wanted) -> Iterator[tuple[list, list]]:
        """(words of lines, their text and offset and line) in groups of bounded size."""
        lines, where, size = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                if wanted(line) and (words := line.split()):
                    lines.append(words), where.append((i, at, line))
                    size += len(words)
                    if size >= VITERBI_CELLS:
                        yield lines, where
                        lines, where, size = [], [], 0
                at += len(line) + 1
        if lines:
            yield lines, where

    def _runs(self, texts: list[str], wanted) -> Iterator[tuple[int, int, str, str, int, int]]:
        """(text, offset of its line, line, label, start, end) of tokens on end with one label but O."""
        for lines, where in self._lines(texts, wanted):
            paths = viterbi([self.emissions(w) for w in lines], self.field.moves, self.field.starts)
            for words, path, (i, at, line) in zip(lines, paths, where, strict=True):
                if not path.any():
                    continue
                spans, pos = [], 0
                for w in words:
                    a = line.index(w, pos)
                    pos = a + len(w)
                    spans.append((a, pos))
                t = 0
                while t < len(path):
                    e = t
                    while e < len(path) and path[e] == path[t]:
                        e += 1
                    label = self.field.labels[path[t]]
                    if label != "O":
                        for a, b in [(t, e)] if label in ("phone", "card") else [(j, j + 1) for j in range(t, e)]:
                            yield i, at, line, label, spans[a][0], spans[b - 1][1]
                    t = e

    def added(self, texts: list[str], taken: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field adds to those taken; none overlaps a taken one."""
        out: list[list] = [[] for _ in texts]
        for i, at, line, kind, start, end in self._runs(texts, lambda line: not self.skip_plain or _TELLING.search(line)):
            while start < end and line[start] in ".,;:!?\"'|*$%&#[]{}<>":
                start += 1
            while start < end and line[end - 1] in ".,;:!?\"'|*$%&#[]{}<>":
                end -= 1
            found = line[start:end]
            near = [(x - at - start, y - at - start) for _, x, y in taken[i] if x < at + end and at + start < y]
            if _plausible(kind, found) and not near:
                out[i].append((kind, at + start, at + end))
            elif kind in ("phone", "card"):
                out[i] += [(kind, at + start + x, at + start + y) for x, y in _split(kind, found, near)]
        return out

    def secrets(self, texts: list[str], taken: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Values that a field of secrets labels, outside the spans taken.  A line without a long mixed value has none."""
        out: list[list] = [[] for _ in texts]
        for i, at, line, kind, start, end in self._runs(texts, lambda line: _VALUE.search(line) and _TELLING.search(line)):
            value = _value_of(line[start:end])
            if value:
                a, b = at + start + value[0], at + start + value[1]
                if not any(x < b and a < y for _, x, y in taken[i]):
                    out[i].append((kind, a, b))
        return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def fit_secrets(**options) -> Field:
    """The field of secrets, on its made table."""
    return fit(secret_table(), labels=SECRET_LABELS, of=secret_features, sides=FAR_SIDES, **options)


def find(docs: DataFrame, field: Field | None = None, text_col: str = "text", secrets: Field | None = None) -> DataFrame:
    """docs with pii_base and pii_added (arrays of kind, start, end in code points) and pii_redacted.

    Whole texts; null counts as empty and its redacted text stays null.
    Base spans come by kind, then start, and always stay; added ones never
    overlap them, nor added secrets the other added ones.  At equal scores of
    two paths the label listed first wins.  Clashing columns of docs are
    replaced; no row is dropped.
    """
    field, secrets = field or fit(labelled_table()), secrets or fit_secrets()
    bounded_batches(docs.sparkSession)
    new = {"pii_base", "pii_added", "pii_redacted"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        finder, hidden = Finder(field), Finder(secrets)
        rows = lambda found: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], span)
        for batch in text_slices(batches, at):
            texts = batch.column(at).to_pylist()
            whole = [t or "" for t in texts]
            base = [base_spans(t) for t in whole]
            added = finder.added(whole, base)
            taken = [b + a for b, a in zip(base, added, strict=True)]
            added = [a + h for a, h in zip(added, hidden.secrets(whole, taken), strict=True)]
            clean = [None if t is None else redact(t, b + a) for t, b, a in zip(texts, base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, rows(base), rows(added), pa.array(clean, pa.string())], names=[*batch.schema.names, "pii_base", "pii_added", "pii_redacted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = "array<struct<kind:string,start:int,end:int>>"
    return docs.mapInArrow(run, f"{schema}, pii_base {kind}, pii_added {kind}, pii_redacted string")
