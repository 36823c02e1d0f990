"""Personal data by fixed patterns and a character model: a bidirectional LSTM with CRF transitions, in numpy.

The patterns find e-mail and IP addresses, card and telephone numbers as they are usually spelled. The model adds what is
spelled otherwise ("name at host dot com", numbers with other marks). It learns from labelled spans: the patterns' own
finds in windows of a bounded sample of all documents (WINDOWS a kind, and as many without), each also respelled at
random, among decoys such as dates and versions. Every text is then read whole, in overlapping windows; each window is
decoded by Viterbi unless a bound on all other paths proves that it has no span. Windows are reconciled over the text:
pieces that a border cut are joined, and of spans that still overlap those are kept whose gains add up highest. A
span of the model stays if it overlaps no span of the patterns and has what its kind must have (a card's check digit, an
address's parts).

Edge cases: a null or empty text has no spans; a text of any length is read whole, in time that grows with it; rows of
null or repeated ids are rows of their own; where no document has a span there is no model and nothing is added; an empty
table gives an empty result; other columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptmill.llm.common import hold, short_batches, utf8_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end: sorts by start, then kind

# -- patterns ---------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the characters before its @ do: one step back each, so that no text takes a square."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Fours of the numbers of a dotted run."""
    for m in _NUMBERS.finditer(text):
        if (run := m[0]).count(".") < 3:
            continue
        parts, start = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_byte, four)):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[Span]:
    """The patterns' spans; of each kind leftmost and apart, of different kinds also one in another."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        out += [(a, 1, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


_AT, _DOT = r"(?:@|\s@\s|\s?[\[({]at[\])}]\s?|\sat\s)", r"(?:\.|\s\.\s|\s?[\[({]dot[\])}]\s?|\sdot\s)"
_OTHER_EMAIL = re.compile(rf"[A-Za-z0-9._%+-]*[A-Za-z0-9]{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
_OTHER_NUMBERS = re.compile(r"[0-9]+(?:[^0-9A-Za-z]{1,3}[0-9]+)*")


def plausible(kind: int, text: str) -> bool:
    """Whether what the model found has what its kind must have."""
    if kind == 0:
        return _OTHER_EMAIL.fullmatch(text) is not None
    digits = _NOT_DIGITS.sub("", text)
    if kind == 1:
        parts = re.split(r"\[dot\]|[^0-9A-Za-z]{1,3}", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    if kind == 2:
        return _OTHER_NUMBERS.fullmatch(text) is not None and 14 <= len(digits) <= 19 and luhn(digits)
    return re.fullmatch(r"[(+]?[0-9](?:[^0-9A-Za-z]{0,3}[0-9])*", text) is not None and 10 <= len(digits) <= 15


# -- the model --------------------------------------------------------------------------------------------------------

#: Characters: letters without case, one sign for digits, marks, blanks, the rest by letter or not.
SIGNS = {c: i + 4 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0 \n@.+-()[]{},:;/_%#=\"'*<>|&!?")}
PAD, LETTER, MARK, BLANK = range(4)
N_SIGNS = len(SIGNS) + 4
_CODE = np.array([SIGNS.get("0" if chr(i).isdigit() else chr(i).lower(), BLANK if chr(i).isspace() else MARK) for i in range(128)] + [LETTER], np.uint8)
#: Sizes of the model, and of the sample it learns from: windows a kind, their characters; batches, their windows, the rate.
WIDTH, EMBED = 10, 8
WINDOWS, WINDOW, STEPS, BATCH, RATE = 500, 128, 400, 64, 0.015
#: Characters of the windows that are read, those that two share, and windows that are read at once.
READ, SHARED, AT_ONCE = 384, 64, 1024
#: Tags: outside, then a first and a further character of each kind.
TAGS = 1 + 2 * len(KINDS)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CODE[np.minimum(points, 128)]


def new_model(seed: int = 0) -> dict[str, np.ndarray]:
    """Gates are rows: in, forget, out, candidate; columns: the state before, the character's embedding, one."""
    rng = np.random.default_rng(seed)
    m = {"embed": rng.normal(0, 0.5, (EMBED, N_SIGNS)), "tags": rng.normal(0, 0.3, (TAGS, 2 * WIDTH)), "bias": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
    for side in ("ahead", "back"):
        w = rng.normal(0, 0.3, (4 * WIDTH, WIDTH + EMBED + 1))
        w[:, -1] = 0
        w[WIDTH : 2 * WIDTH, -1] = 0.5  # remember at first
        m[side] = w
    return {k: v.astype(np.float32) for k, v in m.items()}


def _bend(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: x / (1 + |x|), which is to the model what tanh usually is and takes a fifth of its time here."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def _gates(z: np.ndarray, spare: np.ndarray) -> None:
    """In place: bent to -1..1; the first three to 0..1."""
    _bend(z, spare)
    z[: 3 * WIDTH] *= 0.5
    z[: 3 * WIDTH] += 0.5


def _slope(s: np.ndarray) -> np.ndarray:
    """The slope of a gate's curve where it is s, of 0..1."""
    return 0.5 * (1 - np.abs(2 * s - 1)) ** 2


def _ahead(w: np.ndarray, embed: np.ndarray, signs: np.ndarray, steps: range) -> list[tuple]:
    """What the steps' derivatives need: (input, gates, state before, the state bent, output)."""
    n = signs.shape[1]
    h, c, out = np.zeros((WIDTH, n), np.float32), np.zeros((WIDTH, n), np.float32), []
    one = np.ones((1, n), np.float32)
    for t in steps:
        x = np.concatenate([h, embed[:, signs[t]], one])
        z = w @ x
        _gates(z, np.empty_like(z))
        i, f, o, g = z[:WIDTH], z[WIDTH : 2 * WIDTH], z[2 * WIDTH : 3 * WIDTH], z[3 * WIDTH :]
        before, c = c, f * c + i * g
        tc = c / (1 + np.abs(c))
        h = o * tc
        out.append((x, z, before, tc, h))
    return out


def _derive(w: np.ndarray, steps: list[tuple], d_out: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Derivatives of the weights, and of each step's embeddings."""
    dw, d_embed = np.zeros_like(w), []
    dh, dc = 0.0, 0.0
    for (x, z, before, tc, _), d in zip(reversed(steps), reversed(d_out)):
        i, f, o, g = z[:WIDTH], z[WIDTH : 2 * WIDTH], z[2 * WIDTH : 3 * WIDTH], z[3 * WIDTH :]
        dh = dh + d
        dc = dc + dh * o * (1 - np.abs(tc)) ** 2
        dz = np.concatenate([dc * g * _slope(i), dc * before * _slope(f), dh * tc * _slope(o), dc * i * (1 - np.abs(g)) ** 2])
        dw += dz @ x.T
        dx = w.T @ dz
        dh, dc = dx[:WIDTH], dc * f
        d_embed.append(dx[WIDTH:-1])
    return dw, d_embed[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def loss(m: dict[str, np.ndarray], signs: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean CRF loss of a batch (characters, windows) and its derivatives. A window begins and ends outside of spans' moves:
    only moves between its own characters count."""
    length, n = signs.shape
    ahead = _ahead(m["ahead"], m["embed"], signs, range(length))
    back = _ahead(m["back"], m["embed"], signs, range(length - 1, -1, -1))[::-1]
    h = np.stack([np.concatenate([a[4], b[4]]) for a, b in zip(ahead, back)])  # characters, 2 * WIDTH, windows
    e = np.matmul(m["tags"], h) + m["bias"][:, None]
    moves = m["moves"]
    alpha = [e[0]]
    for t in range(1, length):
        alpha.append(_log_sum(alpha[-1][:, None] + moves[:, :, None], 0) + e[t])
    whole = _log_sum(alpha[-1], 0)
    each = np.arange(n)
    path = sum(e[t, tags[t], each] for t in range(length)) + sum(moves[tags[t - 1], tags[t]] for t in range(1, length))
    d_e, d_moves, beta = np.empty_like(e), np.zeros_like(moves), np.zeros_like(e[0])
    for t in range(length - 1, -1, -1):
        d_e[t] = np.exp(alpha[t] + beta - whole)
        d_e[t, tags[t], each] -= 1
        if t:
            onward = (e[t] + beta)[None] + moves[:, :, None]
            d_moves += np.exp(alpha[t - 1][:, None] + onward - whole).sum(2)
            np.subtract.at(d_moves, (tags[t - 1], tags[t]), 1)
            beta = _log_sum(onward, 1)
    d_e /= n
    d_h = np.matmul(m["tags"].T, d_e)
    d_ahead, x_ahead = _derive(m["ahead"], ahead, list(d_h[:, :WIDTH]))
    d_back, x_back = _derive(m["back"], back[::-1], list(d_h[::-1, WIDTH:]))
    d_x = np.stack(x_ahead) + np.stack(x_back[::-1])
    d_embed = np.stack([np.bincount(signs.ravel(), d_x[:, i].ravel(), N_SIGNS) for i in range(EMBED)])
    return float((whole - path).mean()), {"embed": d_embed, "tags": np.einsum("tkn,thn->kh", d_e, h, optimize=True), "bias": d_e.sum((0, 2)), "moves": d_moves / n, "ahead": d_ahead, "back": d_back}


def respell(rng: np.random.Generator, kind: int, text: str) -> str:
    """The same data spelled as the patterns don't know it."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = _NOT_DIGITS.sub("", text)
    if kind == 0:
        name, host = text.split("@", 1)
        return name + pick(" at ", " AT ", "(at)", " (at) ", "[at]", " [at] ", " @ ", "{at}") + host.replace(".", pick(" dot ", ".", "(dot)", " (dot) ", "[dot]", " [dot] ", " . ", " DOT "))
    if kind == 1:
        return text.replace(".", pick("[.]", " . ", "(.)", ". ", "-", "[dot]", ":"))
    if kind == 2:
        mark = pick(".", "/", "_", "  ", " - ", "--", ":")
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    a, b, c = own[:3], own[3:6], own[6:]
    head = pick("", "", "1-", "001 ", "1 ", "tel:", "Tel. ", "00")
    return head + pick(f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"({a}) {b} {c}")


def _decoy(rng: np.random.Generator) -> str:
    """What looks a little like personal data and isn't."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    forms = (lambda: d(4), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}.{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: d(int(rng.integers(5, 10))), lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: hashlib.sha1(d(6).encode()).hexdigest(), lambda: f"#{d(5)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"p. {d(3)}-{d(3)}", lambda: f"({d(3)})", lambda: f"{d(3)}-{d(4)}", lambda: "at 12.30 . dot", lambda: f"at {d(2)}")
    return forms[rng.integers(len(forms))]()


def _lesson(rng: np.random.Generator, text: str, spans: list[Span]) -> tuple[str, list[Span]]:
    """A window as it is or, as often, with its spans respelled; some get a decoy."""
    if rng.random() < 0.5:
        # Spans of other kinds that lie within a span or across it would be taken apart with it.
        apart = [s for i, s in enumerate(spans) if all(s[0] >= o[2] or o[0] >= s[2] for o in spans[:i] + spans[i + 1 :])]
        for start, kind, end in reversed(apart if len(apart) == len(spans) else []):
            if start == 0 or end == len(text):  # cut by the window
                continue
            new = respell(rng, kind, text[start:end])
            grown = len(new) - (end - start)
            text = text[:start] + new + text[end:]
            spans = [(a, k, b) if b <= start else (a, k, b + grown) if a == start else (a + grown, k, b + grown) for a, k, b in spans]
            if kind == 3:  # "tel:" belongs to no number
                lead = re.match(r"[A-Za-z]+[.:]\s*", new)
                spans = [(a + (lead.end() if lead else 0), k, b) if a == start else (a, k, b) for a, k, b in spans]
    if rng.random() < 0.5 and (blanks := [m.start() for m in re.finditer(" ", text) if not any(a <= m.start() < b for a, _, b in spans)]):
        at, new = blanks[rng.integers(len(blanks))], " " + _decoy(rng)
        text = text[:at] + new + text[at:]
        spans = [(a + len(new), k, b + len(new)) if a >= at else (a, k, b) for a, k, b in spans]
    return text, spans


def _tagged(text: str, spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    signs, tags = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
    signs[: len(text)] = codes(text[:WINDOW])
    for start, kind, end in reversed(spans):  # of spans that overlap the first wins
        tags[start:end] = 2 + 2 * kind
        if start < WINDOW:
            tags[start] = 1 + 2 * kind
    return signs, tags


def train(windows: list[tuple[str, list[Span]]], steps: int = STEPS, seed: int = 0) -> dict[str, np.ndarray]:
    """Adam over batches of lessons; the rate falls to nothing."""
    rng = np.random.default_rng(seed)
    m = new_model(seed)
    mean, square = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    queue: list[int] = []
    for step in range(1, steps + 1):
        while len(queue) < BATCH:
            queue += rng.permutation(len(windows)).tolist()
        part = [_tagged(*_lesson(rng, *windows[i])) for i in queue[:BATCH]]
        del queue[:BATCH]
        _, d = loss(m, np.stack([s for s, _ in part], 1), np.stack([t for _, t in part], 1))
        norm = np.sqrt(sum(float((x * x).sum()) for x in d.values()))
        rate = RATE * (1 - (step - 1) / steps)
        for k in m:
            g = (d[k] * min(1, 5 / (norm + 1e-9))).astype(np.float32)
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            m[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return m


def emissions(m: dict[str, np.ndarray], signs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(characters, tags, windows), for windows with the longest first; what is beyond a window's end means nothing."""
    length, n = signs.shape
    out = np.empty((length, TAGS, n), np.float32)
    active = np.searchsorted(-lengths, -np.arange(length), "left")  # windows that reach beyond each place
    for side, steps in (("ahead", range(length)), ("back", range(length - 1, -1, -1))):
        w, own = m[side], m["tags"][:, :WIDTH] if side == "ahead" else m["tags"][:, WIDTH:]
        x = np.zeros((WIDTH + EMBED + 1, n), np.float32)
        x[-1] = 1
        c, z, tc, spare, e = np.zeros((WIDTH, n), np.float32), np.empty((4 * WIDTH, n), np.float32), np.empty((WIDTH, n), np.float32), np.empty((4 * WIDTH, n), np.float32), np.empty((TAGS, n), np.float32)
        for t in steps:
            k = active[t]
            xk, ck, zk, tk, sk, ek = x[:, :k], c[:, :k], z[:, :k], tc[:, :k], spare[:, :k], e[:, :k]
            np.take(m["embed"], signs[t, :k], axis=1, mode="clip", out=xk[WIDTH:-1]) if k == n else xk.__setitem__(slice(WIDTH, -1), m["embed"][:, signs[t, :k]])
            np.matmul(w, xk, out=zk)
            _gates(zk, sk)
            ck *= zk[WIDTH : 2 * WIDTH]
            np.multiply(zk[:WIDTH], zk[3 * WIDTH :], out=tk)
            ck += tk
            tk[:] = ck
            _bend(tk, sk[:WIDTH])
            np.multiply(zk[2 * WIDTH : 3 * WIDTH], tk, out=xk[:WIDTH])
            np.matmul(own, xk[:WIDTH], out=ek)
            if side == "ahead":
                np.add(ek, m["bias"][:, None], out=out[t, :, :k])
            else:
                out[t, :, :k] += ek
    return out


def may_have_spans(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """False where a bound proves that staying outside is the best path.

    A character in a span adds at most its best tag's lead over outside and the best inner move's; a span adds the moves into
    it and out of it, but for one that begins with the window or ends with it, which holds the character there.
    """
    lead = moves - moves[0, 0]
    enter, leave, inner = lead[0, 1:].max(), lead[1:, 0].max(), max(lead[1:, 1:].max(), 0)
    each, n = e[:, 1:].max(1) - e[:, 0], np.arange(e.shape[2])
    gain = np.maximum(each + inner, 0)
    gain[np.arange(len(e))[:, None] >= lengths] = 0
    gain = gain.sum(0)
    return (gain + enter + leave > 0) | (gain + each[0] + max(leave, 0) > 0) | (gain + each[lengths - 1, n] + max(enter, 0) > 0)


def viterbi(e: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags (characters, windows); 0 beyond a window's end."""
    length, _, n = e.shape
    score, came = e[0].copy(), np.zeros((length, TAGS, n), np.int8)
    for t in range(1, length):
        whole = score[:, None] + moves[:, :, None]
        came[t] = whole.argmax(0)
        new = whole.max(0) + e[t]
        going = t < lengths
        score[:, going] = new[:, going]
    tags, each = np.zeros((length, n), np.int8), np.arange(n)
    now = score.argmax(0)
    for t in range(length - 1, -1, -1):
        here = t < lengths
        tags[t, here] = now[here]
        if t:
            now = np.where(here, came[t, now, each], now)
    return tags


def _pieces(tags: np.ndarray, e: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, end, gain) of a window's tags: gain over staying outside."""
    t, n = 0, len(tags)
    while t < n:
        if not tags[t]:
            t += 1
            continue
        kind, start = (tags[t] - 1) // 2, t
        t += 1
        while t < n and tags[t] == 2 + 2 * kind:
            t += 1
        own = tags[start:t].astype(int)
        gain = float((e[np.arange(start, t), own] - e[start:t, 0]).sum())
        before, after = ([0] if start else []), ([0] if t < n else [])
        path = [*before, *own, *after]
        gain += sum(float(moves[a, b] - moves[0, 0]) for a, b in zip(path, path[1:]))
        yield start, int(kind), t, gain


def reconcile(found: list[tuple[int, int, int, float, bool, bool]]) -> list[Span]:
    """The spans of a text from all its windows' (start, kind, end, gain, cut at its start, cut at its end)."""
    joined: list[list] = []
    for s in sorted(found):
        for o in reversed(joined):
            if s[0] <= o[2] and s[1] == o[1] and (o[5] or s[4]) and (s[0], s[2]) != (o[0], o[2]):  # one text's span, cut by a border
                o[2], o[3], o[5] = max(o[2], s[2]), max(o[3], s[3]), s[5] if s[2] >= o[2] else o[5]
                break
            if o[2] < s[0]:
                joined.append(list(s))
                break
        else:
            joined.append(list(s))
    # Weighted intervals: the best sum of gains up to each end.
    spans = sorted({(s[2], s[0], s[1], s[3]) for s in joined})
    ends, best = [s[0] for s in spans], [(0.0, None, 0)]
    for i, (end, start, kind, gain) in enumerate(spans):
        before = int(np.searchsorted(ends[:i], start, "right"))
        take = best[before][0] + gain
        best.append((take, (start, kind, end), before) if take > best[i][0] else (best[i][0], None, i))
    out, i = [], len(spans)
    while i:
        _, span, before = best[i]
        if span:
            out.append(span)
        i = before
    return out[::-1]


def model_spans(m: dict[str, np.ndarray], texts: list[str]) -> list[list[Span]]:
    """The model's spans of whole texts."""
    own = [codes(t) for t in texts]
    step = READ - SHARED
    windows = [(i, lo) for i, c in enumerate(own) for lo in range(0, max(len(c) - SHARED, 1), step) if len(c)]
    lengths = np.array([min(READ, len(own[i]) - lo) for i, lo in windows], np.int64)
    found: list[list] = [[] for _ in texts]
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), AT_ONCE):
        part = order[at : at + AT_ONCE]
        size = lengths[part]
        signs = np.zeros((len(part), size[0]), np.uint8)
        for row, w in zip(signs, part):
            i, lo = windows[w]
            row[: lengths[w]] = own[i][lo : lo + lengths[w]]
        e = emissions(m, np.ascontiguousarray(signs.T), size)
        some = np.flatnonzero(may_have_spans(e, m["moves"], size))
        if not len(some):
            continue
        e = e[:, :, some]
        tags = viterbi(e, m["moves"], size[some])
        for j in np.flatnonzero(tags.any(0)):
            w = part[some[j]]
            i, lo = windows[w]
            n = lengths[w]
            for start, kind, end, gain in _pieces(tags[:n, j], e[:n, :, j], m["moves"]):
                found[i].append((lo + start, kind, lo + end, gain, start == 0 and lo > 0, end == n and lo + n < len(own[i])))
    return [reconcile(f) if f else [] for f in found]


def added_spans(m: dict[str, np.ndarray] | None, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the model adds to the patterns' spans."""
    if m is None:
        return [[] for _ in texts]
    out = []
    for text, known, own in zip(texts, base, model_spans(m, texts)):
        out.append([s for s in own if all(s[2] <= k[0] or k[2] <= s[0] for k in known) and plausible(s[1], text[s[0] : s[2]])])
    return out


# -- on Spark ---------------------------------------------------------------------------------------------------------


def lessons(docs: DataFrame, windows: int = WINDOWS) -> list[tuple[str, list[Span]]]:
    """Labelled windows of all documents: those of least hash, ``windows`` for each kind and as many without a span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, tuple]] = [{} for _ in range(len(KINDS) + 1)]

        def offer(kind: int, window: str, spans: list[Span]) -> None:
            key = int.from_bytes(hashlib.blake2b(f"{kind}:{window}".encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)
            kept[kind][key] = (window, spans)  # copies are one
            if len(kept[kind]) >= 4 * windows:
                kept[kind] = {k: kept[kind][k] for k in heapq.nsmallest(windows, kept[kind])}

        for b in batches:
            for raw in utf8_texts(b.column(0)):
                text = raw.decode("utf-8", "replace")
                spans = base_spans(text)
                for start, kind, end in spans:
                    if end - start < WINDOW:
                        lo = max(0, start - hash_place(text, start) % (WINDOW - (end - start)))
                        own = [(max(a - lo, 0), k, min(z - lo, WINDOW)) for a, k, z in spans if a < lo + WINDOW and z > lo]
                        offer(kind, text[lo : lo + WINDOW], own)
                if text and not spans:
                    lo = hash_place(text, 0) % max(1, len(text) - WINDOW)
                    offer(len(KINDS), text[lo : lo + WINDOW], [])
        for kind, own in enumerate(kept):
            keys = heapq.nsmallest(windows, own)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array([own[k][0] for k in keys], pa.string()), pa.array([[x for s in own[k][1] for x in s] for k in keys], pa.list_(pa.int32()))], ["kind", "place", "window", "spans"])

    rows = short_batches(docs.select("text")).mapInArrow(run, "kind int, place long, window string, spans array<int>").dropDuplicates(["kind", "place"])
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("place"))).where(F.col("r") <= windows)
    found = sorted(least.collect(), key=lambda r: (r.kind, r.place))  # at most windows * (kinds + 1)
    return [(r.window, [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]) for r in found]


def hash_place(text: str, at: int) -> int:
    """A number that depends on the text around a place alone."""
    return int.from_bytes(hashlib.blake2b(text[max(0, at - 32) : at + 32].encode("utf-8", "replace"), digest_size=4).digest(), "big")


def fit(docs: DataFrame, windows: int = WINDOWS, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """The model, from a bounded sample of windows; None where there is nothing to learn from."""
    own = lessons(docs, windows)
    return train(own, steps) if any(s for _, s in own) else None


def _read(docs: DataFrame, m: dict[str, np.ndarray] | None, schema: str, make) -> DataFrame:
    """``make(ids, texts, base spans, added spans)`` gives a batch of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("personal_data")
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in utf8_texts(b.column(1))]
            base = [base_spans(t) for t in texts]
            yield make(b.column(0), texts, base, added_spans(m, texts, base))

    return short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def find(docs: DataFrame, m: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, kind, start, end, added (by the model) and the span's text: a row for each span."""

    def make(ids, texts, base, added):
        rows = [(i, KINDS[k], a, z, new, t[a:z]) for i, t, b, x in zip(ids.to_pylist(), texts, base, added) for (a, k, z), new in sorted([(s, False) for s in b] + [(s, True) for s in x])]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "kind", "start", "end", "added", "span"])

    return _read(docs, m, "doc_id long, kind string, start long, end long, added boolean, span string", make)


def redact(docs: DataFrame, m: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id and the text, with the name of its kind for each span; spans that overlap are one, named by the first."""

    def masked(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, k, z in sorted(spans):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, z)
        return "".join([*out, text[at:]])

    def make(ids, texts, base, added):
        return pa.RecordBatch.from_arrays([ids, pa.array([masked(t, b + x) for t, b, x in zip(texts, base, added)], pa.string())], ["doc_id", "text"])

    return _read(docs, m, "doc_id long, text string", make)


def digest(docs: DataFrame, windows: int = WINDOWS, steps: int = STEPS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans, all spans, and n_added of the model."""
    listed = lambda spans: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)

    def make(ids, texts, base, added):
        counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
        sha = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
        spans = pa.array([listed(sorted(b + x)) for b, x in zip(base, added)], pa.string())
        return pa.RecordBatch.from_arrays([ids, *counts, sha, spans, pa.array([len(x) for x in added], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return _read(docs, fit(docs, windows, steps), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long", make)
