"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, sampled

KINDS = ("email", "ip", "card", "phone")
STATES = ("other", *KINDS)
TRAIN_ROWS = 2000  # documents with candidates that the field is fitted on, at most
TRAIN_TOKENS = 256  # neighbouring tokens of a training text, at most
FEATURES = 512  # hashed token features
WIDTH = 8  # features of a token
DECAY = 1e-4  # of potentials while they are fitted
PART = 1 << 15  # links whose messages are renewed at a time
MOST_DIGITS = 19  # of groups that are joined into one token
SURE = 0.9  # marginal from which a token counts as an entity
ROUNDS = 12  # of message passing
LEAST_ALIKE = 7  # characters that similar tokens must share

# The kinds' patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_CANDIDATE = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
_GROUP = re.compile(r"[+(]?[0-9][0-9().+/_-]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"[0-9]+")
_AT = re.compile(r"\s*[(\[{]at[)\]}]\s*", re.I)
_OTHER = re.compile(r"[\W_]+")
_BEFORE, _AFTER = "([{<\"'.,;:!?|*#$%&", ")]}>\"'.,;:!?|*#$%&"  # punctuation that is no part of a token


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email pattern; found from the at signs, so long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            # No later match can begin at or before this sign.
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns and their checks find, in order; kinds by their place in KINDS."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _RUN.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Chain:
    """A document's candidate tokens in order: those with a digit or a sign for at, groups of digits joined."""

    span: np.ndarray  # n x 2, code points
    state: np.ndarray  # of tokens that are base spans or overlap one; -1 for others
    features: np.ndarray  # n x WIDTH
    skips: np.ndarray  # m x 2, pairs of repeated or similar tokens, the earlier one first


def _bucket(told: str) -> int:
    return zlib.crc32(told.encode("utf-8", "surrogatepass")) % FEATURES


def _shape(token: str) -> str:
    return _LETTERS.sub("a", _RUN.sub(lambda m: "d" if len(m[0]) < 3 else "D" if len(m[0]) < 9 else "N", token[:64]))[:24]


def units(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, state) of candidate tokens in order, in time linear in the text.

    A base span is a token of its kind, as is what hangs on it without white
    space. Other tokens are split at white space and lose the punctuation around
    them; neighbours that are groups of digits make one token, as long as it
    has MOST_DIGITS of them at most.
    """
    j, at, held = 0, 0, None  # held: start, end, digits of groups that may go on
    while at < len(text):
        while j < len(base) and base[j][2] <= at:
            j += 1
        m = _WORD.search(text, at)
        if m is None:
            break
        a, b = m.span()
        if j < len(base) and base[j][0] < b:
            # Base spans that overlap are one token of the first one's kind.
            kind, end, stop = base[j][1], base[j][2], max(b, base[j][2])
            while j < len(base) and base[j][0] < stop:
                end, stop, j = max(end, base[j][2]), max(stop, base[j][2]), j + 1
            if held:
                yield held[0], held[1], -1
                held = None
            m = _WORD.match(text, stop)
            yield a, (m.end() if m and not text[stop - 1].isspace() else stop), kind + 1
            at = m.end() if m and not text[stop - 1].isspace() else stop
            continue
        at = b
        raw = m[0]
        if not _CANDIDATE.search(raw):
            if held:
                yield held[0], held[1], -1
                held = None
            continue
        a, b = a + len(raw) - len(raw.lstrip(_BEFORE)), b - len(raw) + len(raw.rstrip(_AFTER))
        if raw[:1] == "(" and a > m.start() and _GROUP.fullmatch(raw.rstrip(_AFTER + ")")):
            a = m.start()  # (555) 123-4567
        if b <= a:
            continue
        group = _GROUP.fullmatch(text, a, b) is not None or (raw[0] == "(" and _GROUP.fullmatch(raw.rstrip(".,;:!?")) is not None)
        digits = sum(map(str.isdigit, text[a:b])) if group else 0
        if held and group and a - held[1] <= 2 and held[2] + digits <= MOST_DIGITS:
            held = (held[0], b, held[2] + digits)
            continue
        if held:
            yield held[0], held[1], -1
        held = (a, b, digits) if group else None
        if not group:
            yield a, b, -1
    if held:
        yield held[0], held[1], -1


def chain(text: str, base: list[tuple[int, int, int]]) -> Chain:
    """Candidate tokens with their features and skip links.

    A token links to the last one before it that has the same letters and
    digits, and to the last ones that begin, or for numbers end, with the same
    LEAST_ALIKE of them: three links back at most, however often a value
    repeats.
    """
    span, state, features, skips = [], [], [], []
    last: dict[str, int] = {}
    for a, b, kind in units(text, base):
        token = _AT.sub("@", text[a:b])
        key = _OTHER.sub("", token.lower())
        if not key:
            continue
        i = len(span)
        span.append((a, b))
        state.append(kind)
        digits = sum(map(str.isdigit, key))
        number = digits == len(key)
        before = text[max(0, a - 12) : a].split()
        told = (
            f"s:{_shape(text[a:b])}", f"d:{min(digits, 20)}", f"l:{min(len(token), 40) // 2}", f"@:{'@' in token}{'@' in text[a:b]}",
            f".:{min(token.count('.'), 4)}", f"n:{number}", f"g:{min(len(_RUN.findall(token[:64])), 6)}", f"w:{(before[-1] if before else '').lower()[-8:]}",
        )
        features.append([_bucket(f) for f in told])
        marks = [f"={key}"]
        if len(key) >= LEAST_ALIKE:
            marks.append(f"<{key[:LEAST_ALIKE]}")
            if number:
                marks.append(f">{key[-LEAST_ALIKE:]}")
        skips += [(x, i) for x in sorted({last[m] for m in marks if m in last})]
        last.update(dict.fromkeys(marks, i))
    return Chain(
        np.array(span, np.int64).reshape(-1, 2), np.array(state, np.int8), np.array(features, np.int16).reshape(-1, WIDTH), np.array(skips, np.int32).reshape(-1, 2)
    )


@dataclass(frozen=True)
class Field:
    """Potentials: of a token's features, of neighbouring states, of the states that a skip link joins."""

    unary: np.ndarray  # FEATURES + 1 x states
    chain: np.ndarray  # states x states
    skip: np.ndarray  # states x states

    def tokens(self, c: Chain) -> np.ndarray:
        """Each token's own potentials; those of base spans hold it at its kind."""
        u = np.empty((len(c.span), len(STATES)), np.float32)
        for i in range(0, len(u), PART):
            u[i : i + PART] = self.unary[c.features[i : i + PART]].sum(1) + self.unary[-1]
        fixed = np.flatnonzero(c.state >= 0)
        u[fixed] = -30.0
        u[fixed, c.state[fixed]] = 30.0
        return u

    def marginals(self, c: Chain) -> np.ndarray:
        """Loopy sum-product over the chain and its skip links.

        Messages are kept as floats, two for each link, and renewed PART links
        at a time, so memory is some 200 bytes a candidate token and none for
        other text.
        """
        n, u = len(c.span), self.tokens(c)
        near = np.arange(max(n - 1, 0), dtype=np.int32)
        kinds = [(np.stack([near, near + 1], 1), self.chain), (c.skips, self.skip)]
        kinds = [(links, pot.astype(np.float32)) for links, pot in kinds if len(links)]
        told = [(np.zeros((len(links), len(STATES)), np.float32), np.zeros((len(links), len(STATES)), np.float32)) for links, _ in kinds]
        belief = u.copy()
        for _ in range(ROUNDS):
            change, nxt = 0.0, u.copy()
            for (links, pot), (fore, back) in zip(kinds, told, strict=True):
                for s in range(0, len(links), PART):
                    part = slice(s, s + PART)
                    a, b = links[part, 0], links[part, 1]
                    new_fore, new_back = _send(belief[a] - back[part], pot), _send(belief[b] - fore[part], pot.T)
                    change = max(change, float(np.abs(new_fore - fore[part]).max()), float(np.abs(new_back - back[part]).max()))
                    fore[part] += 0.5 * (new_fore - fore[part])
                    back[part] += 0.5 * (new_back - back[part])
                    np.add.at(nxt, b, fore[part])
                    np.add.at(nxt, a, back[part])
            belief = nxt
            if change < 1e-3:
                break
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _send(incoming: np.ndarray, pot: np.ndarray) -> np.ndarray:
    top = incoming.max(1, keepdims=True)
    out = np.log(np.exp(np.maximum(incoming - top, -60)) @ np.exp(pot))
    return out - out.max(1, keepdims=True)


def fit(chains: list[Chain], steps: int = 200) -> Field:
    """A field by pseudo-likelihood: each open token's state given the states beside it and along its skip links.

    Base spans are evidence, not examples: at inference they are held at their
    kind, so what is learned is how other tokens look and whom they follow.
    """
    k = len(STATES)
    xs, ys, sides, links = [], [], [], []
    for c in chains:
        n, told = len(c.state), c.state.astype(np.int64)
        true = np.where(told < 0, -1 - told, told)  # see lesson
        open_ = np.flatnonzero(c.state < 0)
        one = np.eye(k)[true]
        left, right, skip = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
        left[1:], right[:-1] = one[:-1], one[1:]
        if len(c.skips):
            np.add.at(skip, c.skips[:, 0], one[c.skips[:, 1]])
            np.add.at(skip, c.skips[:, 1], one[c.skips[:, 0]])
        xs.append(c.features[open_])
        ys.append(true[open_])
        sides.append(np.stack([left[open_], right[open_]], 1))
        links.append(skip[open_])
    w, pair, skip = np.zeros((FEATURES + 1, k)), np.zeros((k, k)), np.zeros((k, k))
    if not xs or not sum(map(len, ys)):
        w[-1, 0] = 4.0
        return Field(w, pair, skip)
    x, y, side, link = (np.concatenate(v) for v in (xs, ys, sides, links))
    x = x.astype(np.int64)
    target = np.eye(k)[y]
    state = [w, pair, skip]
    m, v = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for t in range(1, steps + 1):
        z = w[x].sum(1) + w[-1] + side[:, 0] @ pair + side[:, 1] @ pair.T + link @ skip
        p = np.exp(z - z.max(1, keepdims=True))
        r = (p / p.sum(1, keepdims=True) - target) / len(x)
        gw = np.zeros_like(w)
        for col in range(x.shape[1]):
            gw[:-1] += np.stack([np.bincount(x[:, col], r[:, s], FEATURES) for s in range(k)], 1)
        gw[-1] = r.sum(0)
        gs = link.T @ r
        grads = [gw + DECAY * w, side[:, 0].T @ r + (side[:, 1].T @ r).T + DECAY * pair, (gs + gs.T) / 2 + DECAY * skip]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            state[i] -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(w, pair, skip)


def altered(value: str, kind: int, pick: random.Random) -> str:
    """A value of a kind as people rewrite it, so that its pattern no longer finds it."""
    digits = _OTHER.sub("", value)
    if kind == 0:
        name, host = value.rsplit("@", 1)
        return pick.choice([f"{name}(at){host}", f"{name}[at]{host}", f"{name}@{host.split('.')[0]}", f"{name}@{host.replace('.', ',')}"])
    if kind == 1:
        return value.replace(".", pick.choice(["-", "_", ",", ":"]))
    if kind == 2:
        sep = pick.choice([".", "_", "/"])
        return pick.choice([sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits[:-1] + "x", digits[:-4] + "xxxx", digits[:-1] + str((int(digits[-1]) + 1) % 10)])
    return pick.choice([digits, f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"])


def _decoy(kind: int, pick: random.Random) -> str:
    """A value of its own that looks like an altered one of a kind."""
    n = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
    name = "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randint(3, 9)))
    true = (f"{name}{n(2)}@{name[::-1]}.example", ".".join(str(pick.randrange(256)) for _ in range(4)), n(16), f"1{n(10)}")[kind]
    return altered(true, kind, pick)


def lesson(text: str, seed: int) -> list[Chain]:
    """Training chains of a text: as it is, and with altered repeats of its base spans and decoys put in between its words.

    Open tokens carry -1 - state: what is put in as a repeat is of its span's
    kind, all else is other. TRAIN_TOKENS neighbouring tokens a chain at most,
    from a seeded place.
    """
    pick = random.Random(seed)
    base = base_spans(text)
    out = [chain(text, base)]
    out[0].state = np.where(out[0].state < 0, -1, out[0].state).astype(np.int8)
    words = list(_WORD.finditer(text))
    if words:
        holes = [m.end() for m in words if not any(s < m.end() < e for s, _, e in base[:64])]
        put = [(pick.choice(holes), altered(text[s:e], k, pick), k + 1) for s, k, e in pick.sample(base, min(3, len(base))) if holes]
        put += [(pick.choice(holes), _decoy(pick.randrange(4), pick), 0) for _ in range(3) if holes]
        parts, at, said, length = [], 0, [], 0
        for hole, value, state in sorted(put, key=lambda p: p[0]):
            piece = text[at:hole] + " "
            said.append((length + len(piece), length + len(piece) + len(value), state))
            parts += [piece, value]
            length += len(piece) + len(value)
            at = hole
        new = "".join(parts) + " " + text[at:].lstrip() if parts else text
        c = chain(new, base_spans(new))
        for a, b, state in said:
            c.state[(c.state < 0) & (c.span[:, 0] < b) & (c.span[:, 1] > a)] = -1 - state
        out.append(c)
    return [_window(c, pick) for c in out if len(c.span)]


def _window(c: Chain, pick: random.Random) -> Chain:
    if len(c.span) <= TRAIN_TOKENS:
        return c
    a = pick.randrange(len(c.span) - TRAIN_TOKENS)
    s = slice(a, a + TRAIN_TOKENS)
    inside = c.skips[(c.skips[:, 0] >= a) & (c.skips[:, 1] < a + TRAIN_TOKENS)] - a
    return Chain(c.span[s], c.state[s], c.features[s], inside)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field fitted on a bounded sample: TRAIN_ROWS documents with candidates at most, those of the smallest hashes.

    One row an id (that of the smallest text hash), TRAIN_TOKENS tokens of a
    text as it is and as many of its altered copy (:func:`lesson`); only
    features, states and links come to the driver. Null ids and texts take no
    part. An empty table gives a field that adds nothing.
    """
    spark = ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, k, c.state.tobytes(), c.features.tobytes(), c.skips.astype(np.int32).tobytes())
                for i, t in zip(b["id"], b["text"], strict=True)
                for k, c in enumerate(lesson(t, i))
            ]
            yield pd.DataFrame(rows, columns=["id", "k", "state", "features", "skips"])

    some = docs.where(F.col(id_col).isNotNull() & F.col(text_col).rlike("[0-9@]")).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sign")
    )
    chosen = sampled(some.groupBy("id").agg(F.min("sign").alias("sign")), TRAIN_ROWS, "id").collect()
    ids = spark.createDataFrame([(r["id"], r["sign"]) for r in chosen], "chosen long, sign long")
    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(ids), (F.col("id") == F.col("chosen")) & (F.xxhash64("text") == F.col("sign")), "left_semi")  # TRAIN_ROWS ids at most
        .mapInPandas(run, "id long, k int, state binary, features binary, skips binary")
        .dropDuplicates(["id", "k"])
        .collect()
    )
    rows.sort(key=lambda r: (r["id"], r["k"]))
    none = np.zeros((0, 2), np.int64)
    return fit(
        [
            Chain(none, np.frombuffer(r["state"], np.int8), np.frombuffer(r["features"], np.int16).reshape(-1, WIDTH), np.frombuffer(r["skips"], np.int32).reshape(-1, 2))
            for r in rows
        ]
    )


def spans(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """Base spans, and other tokens that the field is SURE are of a kind, in order.

    Messages along the chain and its skip links decide; a token without a link
    or a neighbour that says so only has its own looks, which the decoys of
    training make unsure.
    """
    base = base_spans(text)
    if not text or not _CANDIDATE.search(text):
        return base
    c = chain(text, base)
    open_ = np.flatnonzero(c.state < 0)
    if not len(open_):
        return base
    p = field.marginals(c)[open_]
    sure = np.flatnonzero(p[:, 1:].max(1) >= SURE)
    return sorted(base + [(int(c.span[open_[i], 0]), int(p[i, 1:].argmax()), int(c.span[open_[i], 1])) for i in sure])


def written(spans_: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans_)


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every row's whole text (null: empty).

    Returns doc_id; n_email, n_ip, n_card, n_phone, how many base spans of
    each kind there are; base_sha256, the digest of the base spans as
    kind:start:end, by start, then kind, comma-joined (code points, end
    exclusive); spans, base and added ones in that form. Rows stay one for one,
    repeated ones and those with a null id as well; an empty table gives none.
    Time and memory are linear in a text, however long. Other columns of
    ``docs`` play no part, whatever their names.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(field)  # FEATURES rows of weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                base = base_spans(t)
                n = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans(t, shared.value))))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"])
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each span, and what overlaps it, replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out.append(text[at:s])
            out.append(f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; n_chars, if there is such a column, is counted anew.

    Every row stays, with the columns of ``docs`` as they are named; a null
    text stays null. Handles long texts, repeats and empty tables as :func:`find` does.
    """
    shared = ready(docs.sparkSession).sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def cover(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, spans(t, shared.value)) for t in texts], dtype=object)

    out = docs.withColumn(text_col, cover(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
