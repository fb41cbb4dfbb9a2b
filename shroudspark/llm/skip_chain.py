"""Personal data by a skip-chain conditional random field.

The variables are the tokens of a document, the labels O and the kinds of personal data.
Neighbouring tokens share a chain potential; tokens that repeat, or differ in case and
punctuation only, share a skip potential with their last occurrence, however far back.
What keywords tell of one mention is a feature of all mentions of that token in the
document, so it does not fade with distance, and loopy sum-product message passing, run
until each document's messages converge, makes labels consistent.

Label O alone is allowed for a token without evidence of its own or told by another
mention: one that has no digit, at sign or vendor's key prefix, that no assignment to a
secret's name, no title and no name label precedes, and that repeats no token for which
one of these holds.  Such tokens are clamped, in training as in inference; they act on
their neighbours through the chain potential and as context.  Weights are learnt by
pseudo-likelihood on generated examples.
"""

from __future__ import annotations

import random
import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroudspark.llm._common import bounded_batches, with_text
from shroudspark.llm._words import chunks, string_buffer

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "PERSON")
_GROUPED = ("PHONE", "CARD", "PERSON")  # may be written as several tokens
_L = len(LABELS)
_CLOSE = 1e-7  # a document's messages have converged when none changes by more in a round
_ROUNDS = 1000  # only for a document whose messages never settle
_DAMP = 0.3  # share of the old message
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OUTSIDE = ".,;:!?\"'`<>[]{}#$%&*|~^"

_SHAPES: list[tuple[str, re.Pattern[str]]] = [
    (name, re.compile(pattern))
    for name, pattern in (
        ("email", r"[\w.+-]+@(?:[\w-]+\.)+[A-Za-z]{2,}$"),
        ("at", r".*@"),
        ("aws", r"A[KS]IA[A-Z0-9]{16}$"),
        ("vendor", r"(?:gh[pousr]_\w{20,}|xox[baprs]-[\w-]{10,}|[rs]k_(?:live|test)_\w{16,}|AIza[\w-]{30,})$"),
        ("assigned", r"(?i:[\w-]*(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))[=:]\"?\S{8,}$"),
        ("quad", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?::\d{1,5}|/\d{1,2})?$"),
        ("badquad", r"(?:\d{1,4}\.){3}\d{1,4}$"),
        ("plus", r"\+\d{1,3}$"),
        ("plusphone", r"\+\d[\d()./-]{7,18}$"),
        ("area", r"\(\d{2,5}\)$"),
        ("local", r"\d{3}[-.]\d{4}$"),
        ("phone", r"\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}$"),
        ("date", r"\d{4}-\d{2}-\d{2}$|\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$"),
        ("time", r"\d{1,2}:\d{2}(?::\d{2})?$"),
        ("version", r"v?\d+(?:\.\d+)+[a-z]?$"),
        ("hex", r"(?=\w*\d)[0-9a-fA-F]{32,}$"),
        ("mixed", r"(?=\w*\d)(?=\w*[A-Za-z])[\w-]{16,}$"),
        ("four", r"\d{4}$"),
        ("few", r"\d{1,3}$"),
        ("some", r"\d{5,9}$"),
        ("many", r"\d{10,12}$"),
        ("code", r"(?=\w*\d)[A-Za-z0-9_-]+$"),
        ("capital", r"[A-Z\u00c0-\u00de][a-z\u00df-\u00ff]+(?:[-'\u2019][A-Z\u00c0-\u00de]?[a-z\u00df-\u00ff]+)*$"),
        ("initial", r"[A-Z]$"),
        ("letters", r"[^\W\d_]{8,}$"),
    )
]
_NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau)\.?|[Dd]ear|(?:[Nn]ame|[Cc]ontact|[Aa]ttn|[Aa]ttention|[Pp]atient|[Cc]ustomer|[Ee]mployee):"
_KEYWORDS = {
    "assign": re.compile(rf"(?i)(?:{_NAMES})[\"']?\s*[:=]\W*$|bearer$"),
    "name": re.compile(rf"(?:^|[\s\W])(?:{_TITLES})$"),
    "secret": re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|bearer)\W*$"),
    "phone": re.compile(r"(?i)(?:phone|mobile|tel|call|fax|cell)\W*$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex)\W*$"),
}
_NATIONAL = re.compile(r"0\d(?: \d{2}){4}|0\d{3} \d{3} \d{3}|0\d{2,4} \d{3,4} \d{4}|\(0\d{1,3}\) \d{4} \d{4}")
# Where tokens without a digit or an at sign may begin that are variables.
_VENDORS = re.compile(rb"A[KS]IA|gh[pousr]_|xox[baprs]-|[rs]k_(?:live|test)_|AIza")
_ASSIGNED = re.compile(rf"(?i:{_NAMES})[\"']?[ \t]*$".encode())
_BEARER = re.compile(rb"[Bb]earer[ \t]+(?=\S)")
_TITLED = re.compile(rf"\b(?:{_TITLES})[ \t]+(?=[A-Z\xc3])".encode("latin-1"))


class Token(NamedTuple):
    text: str  # as it stands
    before: tuple[str, str]  # the two tokens in front, nearest last; empty at the start


def bare(text: str) -> str:
    return text.strip(_OUTSIDE)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def shape(text: str) -> str:
    core = bare(text)
    digits = core.replace("-", "")
    if digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19:
        return "luhn" if _luhn(digits) else "long"
    for name, pattern in _SHAPES:
        if pattern.match(core):
            return name
    return "other"


def node_features(token: Token, left: str | None, right: str | None) -> list[str]:
    """Names of the active features; ``left`` and ``right`` are shapes of direct neighbours."""
    own = shape(token.text)
    out = ["bias", f"shape={own}", f"left={left}|{own}", f"right={right}|{own}"]
    out += [f"key={name}|{own}" for name in _keywords(token)]
    return out


class Graph(NamedTuple):
    """Variables of some documents and their edges (first, second, 0 chain or 1 skip)."""

    features: list[list[str]]
    walls: np.ndarray  # sides of each variable at which a token is clamped to O
    edges: np.ndarray
    document: np.ndarray | None = None  # of each variable; none: all are of one


def _key_of(text: str) -> str:
    """What mentions of one token have in common; empty if it is too short to mean the same again."""
    key = re.sub(r"[\W_]+", "", text).lower()
    return key if len(key) >= 4 else ""


def _keywords(token: Token) -> list[str]:
    near = token.before[1]
    behind = token.before[0] + " " + token.before[1] if not re.search(r"\w", near) else near.lstrip("([\"'")
    return [name for name, pattern in _KEYWORDS.items() if pattern.search(behind)]


def _runs(tokens: list[tuple[int, Token]], shapes: list[str]) -> list[set[str]]:
    """What neighbouring numbers are together: a card in groups, or a national phone number."""
    found: list[set[str]] = [set() for _ in tokens]
    for k, (number, token) in enumerate(tokens):
        core = bare(token.text)
        if shapes[k] != "four" and not core.startswith(("0", "(0")):
            continue
        cores = [core]
        while len(cores) < 5 and k + len(cores) < len(tokens) and tokens[k + len(cores)][0] == number + len(cores):
            cores.append(bare(tokens[k + len(cores)][1].text))
        for sizes in ((4, 4, 4, 4), (4, 6, 5)):
            part = cores[: len(sizes)]
            if tuple(map(len, part)) == sizes and (digits := "".join(part)).isascii() and digits.isdigit() and _luhn(digits):
                for n in range(len(sizes)):
                    found[k + n].add("card")
        for size in range(len(cores), 1, -1):
            if _NATIONAL.fullmatch(" ".join(cores[:size])):
                for n in range(size):
                    found[k + n].add("phone")
                break
    return found


def build(documents: list[list[tuple[int, Token]]]) -> Graph:
    """The graph of documents given by their variables, each with its number in the document."""
    features: list[list[str]] = []
    walls: list[int] = []
    edges: list[tuple[int, int, int]] = []
    for tokens in documents:
        base, last = len(features), {}
        shapes = [shape(t.text) for _, t in tokens]
        keys = [_key_of(t.text) for _, t in tokens]
        runs = _runs(tokens, shapes)
        told: dict[str, set[str]] = {}
        for key, (_, token) in zip(keys, tokens):
            if key:
                told.setdefault(key, set()).update(_keywords(token))
        for k, (number, token) in enumerate(tokens):
            before = k > 0 and tokens[k - 1][0] == number - 1
            after = k + 1 < len(tokens) and tokens[k + 1][0] == number + 1
            features.append(node_features(token, shapes[k - 1] if before else None, shapes[k + 1] if after else None))
            key = keys[k]
            features[-1] += [f"told={name}|{shapes[k]}" for name in sorted(told.get(key, ()))]
            features[-1] += [f"run={name}|{shapes[k]}" for name in sorted(runs[k])]
            walls.append(2 - before - after)
            if before:
                edges.append((base + k - 1, base + k, 0))
            if key:
                if key in last and not (before and last[key] == base + k - 1):  # direct neighbours share the chain already
                    edges.append((last[key], base + k, 1))
                last[key] = base + k
    document = np.repeat(np.arange(len(documents)), [len(tokens) for tokens in documents])
    return Graph(features, np.array(walls, dtype=float), np.array(edges, dtype=np.int64).reshape(-1, 3), document)


class Field(NamedTuple):
    """Weights: of features by label, and the symmetric chain and skip potentials."""

    index: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray  # (2, labels, labels)

    def nodes(self, graph: Graph) -> np.ndarray:
        out = np.zeros((len(graph.features), _L))
        for k, names in enumerate(graph.features):
            for name in names:
                at = self.index.get(name)
                if at is not None:
                    out[k] += self.weight[at]
        return out + graph.walls[:, None] * self.pair[0, 0]

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of every variable by loopy sum-product."""
        nodes = self.nodes(graph)
        if len(nodes) == 0:
            return nodes
        e = graph.edges
        source = np.concatenate((e[:, 0], e[:, 1]))
        target = np.concatenate((e[:, 1], e[:, 0]))
        potential = self.pair[np.concatenate((e[:, 2], e[:, 2]))]
        back = np.concatenate((np.arange(len(e)) + len(e), np.arange(len(e))))
        messages = np.zeros((len(source), _L))
        document = np.zeros(len(nodes), dtype=np.int64) if graph.document is None else graph.document
        of = document[target]
        live = np.arange(len(source))  # messages of documents that haven't converged; no other document can matter to them
        for _ in range(_ROUNDS):
            if not len(live):
                break
            at, own, potentials = np.unique(target[live], return_inverse=True), messages[live], potential[live]
            place = np.searchsorted(at[0], source[live])  # edges go both ways, so every source is a target
            belief = self._gather(nodes[at[0]], at[1], own)
            out = (belief[place] - messages[back[live]])[:, :, None] + potentials
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            new = _DAMP * own + (1 - _DAMP) * new
            messages[live] = new
            moves = np.zeros(document[-1] + 1, dtype=bool)
            moves[of[live[np.abs(new - own).max(1) > _CLOSE]]] = True
            live = live[moves[of[live]]]
        belief = self._gather(nodes, target, messages)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    @staticmethod
    def _gather(nodes: np.ndarray, target: np.ndarray, messages: np.ndarray) -> np.ndarray:
        return nodes + np.stack([np.bincount(target, weights=messages[:, y], minlength=len(nodes)) for y in range(_L)], 1)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _hex(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(n - 1)) + rng.choice("0123456789")


def _card(rng: random.Random) -> str:
    digits = rng.choice("3456") + _digits(rng, rng.choice((14, 14, 14, 13)))
    return digits + next(c for c in "0123456789" if _luhn(digits + c))


def examples(n: int, seed: int) -> list[list[tuple[str, int]]]:
    """Generated documents as (token, label) pairs: personal data, things that look like it, and words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorstldé") for _ in range(rng.randrange(2, 9)))
    octet = lambda: str(rng.randrange(256))
    tail = lambda: rng.choice(("", "", "", "", ".", ",", "!!", "###"))

    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH!-") for _ in range(n - 1)) + rng.choice("abcdefgh")
    name = lambda: "".join(rng.choice("AEINORSTLD")) + "".join(rng.choice("aeinorstldé") for _ in range(rng.randrange(3, 9)))

    def person() -> list[tuple[str, int]]:
        lead = rng.choice(("Mr", "Mrs", "Ms.", "Dr.", "Prof", "Dear", "name:", "Contact:", "Patient:"))
        middle = [(rng.choice("ABCDEFGH") + ".", 6)] if rng.random() < 0.15 else []
        return [(lead, 0), (name(), 6), *middle, *([(name(), 6)] if middle or rng.random() < 0.6 else [])]

    def secret() -> list[tuple[str, int]]:
        kind = rng.randrange(8)
        if kind == 5:
            return [(rng.choice(("password", "pwd", "secret", "token")) + rng.choice("=:") + letters(rng.randrange(9, 25)), 5)]
        if kind == 6:
            return [(rng.choice(("password:", "secret:", "token:", "passwd:")), 0), (letters(rng.randrange(9, 25)), 5)]
        if kind == 7:
            head, size = rng.choice((("ASIA", 0), ("ghp_", 36), ("gho_", 36), ("xoxb-", 24), ("sk_live_", 24), ("rk_test_", 24), ("AIza", 35)))
            return [(head + ("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16)) if not size else letters(size).replace("!", "x").replace("-", "y")), 5)]
        if kind == 0:
            return [("AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), 5)]
        if kind == 1:
            return [(rng.choice(("token", "secret", "api_key", "password")), 0), (rng.choice(("=", ":")), 0), (f'"{_hex(rng, rng.choice((32, 40, 64)))}"', 5)]
        if kind == 2:
            return [(rng.choice(("password", "pwd", "secret", "token", "api_key")) + rng.choice("=:") + _hex(rng, rng.randrange(10, 40)), 5)]
        if kind == 3:
            return [(rng.choice(("ghp_", "sk_live_", "xoxb-")) + _hex(rng, 36), 5)]
        return [(rng.choice(("Bearer", "token:", "password:")), 0), (_hex(rng, 40), 5)]

    def phone() -> list[tuple[str, int]]:
        form = rng.choice(
            (
                f"+1 ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}",
                f"+1 ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}",
                f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}",
                f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}",
                f"+{rng.randrange(20, 99)} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}",
                f"+{rng.randrange(20, 99)}-{_digits(rng, 3)}-{_digits(rng, 6)}",
                f"04{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 3)}",
                f"0{_digits(rng, 1)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)} {_digits(rng, 2)}",
                f"0{_digits(rng, 2)} {_digits(rng, 4)} {_digits(rng, 4)}",
                f"(0{_digits(rng, 1)}) {_digits(rng, 4)} {_digits(rng, 4)}",
            )
        )
        lead = [(rng.choice(("phone", "call", "tel:", "mobile")), 0)] if rng.random() < 0.3 else []
        return lead + [(t, 2) for t in form.split(" ")]

    def card() -> list[tuple[str, int]]:
        digits = _card(rng)
        lead = [(rng.choice(("card", "Card:", "visa", "amex:")), 0)] if rng.random() < 0.3 else []
        form = rng.random()
        if len(digits) == 16 and form < 0.15:
            digits = "-".join(digits[k : k + 4] for k in range(0, 16, 4))
        elif len(digits) == 16 and form < 0.4:
            return lead + [(digits[k : k + 4], 3) for k in range(0, 16, 4)]
        elif len(digits) == 15 and form < 0.4:
            return lead + [(part, 3) for part in (digits[:4], digits[4:10], digits[10:])]
        return [*lead, (digits, 3)]

    def other() -> list[tuple[str, int]]:
        long = _digits(rng, rng.randrange(13, 20))
        return [
            (t, 0)
            for t in rng.choice(
                (
                    f"version {rng.randrange(9)}.{rng.randrange(20)}",
                    f"{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(30)}",
                    str(rng.randrange(10 ** rng.randrange(1, 10))),
                    str(rng.randrange(1900, 2100)),
                    f"20{_digits(rng, 2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}",
                    f"{rng.randrange(24)}:{rng.randrange(10, 60)}",
                    f"${rng.randrange(1000)}.{_digits(rng, 2)}",
                    long if not _luhn(long) else "7",
                    f"{rng.randrange(300, 999)}.{octet()}.{octet()}.{octet()}",
                    f"({rng.randrange(100)})",
                    "@" + word(),
                    word() + "@" + word(),
                    _hex(rng, 7),
                    word().upper()[:2] + _digits(rng, 6),
                    word() + str(rng.randrange(100)),
                    f"commit {_hex(rng, 40)}",
                    f"{rng.randrange(100)} {rng.randrange(100)}",
                    f"{rng.randrange(1900, 2100)} {rng.randrange(1900, 2100)} {rng.randrange(1900, 2100)}",
                    f"0{rng.randrange(10)} {rng.randrange(100)}",
                    f"card {rng.randrange(1000, 9999)}",
                )
            ).split(" ")
        ]

    out = []
    for _ in range(n):
        doc: list[tuple[str, int]] = []
        past: list[tuple[str, int]] = []
        for _ in range(rng.randrange(3, 12)):
            doc += [(word(), 0) for _ in range(rng.randrange(0, 6))]
            kind = rng.randrange(13)
            if past and kind in (0, 11):  # again, without what told it the first time
                part = [rng.choice(past)]
            elif kind < 2:
                part = [(f"{word()}.{rng.randrange(100)}@{word()}.example.{rng.choice(('com', 'org', 'de'))}", 1)]
            elif kind < 4:
                part = phone()
            elif kind < 5:
                part = card()
            elif kind < 6:
                part = [(".".join(octet() for _ in range(4)), 4)]
            elif kind < 8:
                part = secret()
            elif kind == 12:
                part = person()
            else:
                part = other()
            past += [x for x in part if x[1] in (1, 4, 5) or x[1] == 3 and len(x[0]) > 8 or len(x[0]) == 40]
            past += [(t, 6) for t, label in part if label == 6 and len(t) > 3] + [(t.lower(), 0) for t, label in part if label == 6 and len(t) > 3]
            end = tail()
            doc += [*part[:-1], (part[-1][0] + end, part[-1][1])]
        out.append(doc)
    return out


def _bytes(words: list[str]) -> np.ndarray:
    return np.frombuffer(" ".join(words).encode(), dtype=np.uint8)


def labelled(docs: list[list[tuple[str, int]]]) -> tuple[Graph, np.ndarray]:
    """The graph of documents given as (token, label) pairs, and the labels of its variables."""
    tokens = [variables(_bytes([t for t, _ in doc]))[0] for doc in docs]
    return build(tokens), np.array([doc[k][1] for doc, own in zip(docs, tokens) for k, _ in own])


@cache
def train(n: int = 1500, seed: int = 11, rounds: int = 300, decay: float = 2e-4) -> Field:
    """Maximum pseudo-likelihood of generated examples, by full-batch AdaGrad."""
    docs = examples(n, seed)
    graph, gold = labelled(docs)
    names = sorted({name for f in graph.features for name in f})
    index = {name: k for k, name in enumerate(names)}
    node = np.repeat(np.arange(len(gold)), [len(f) for f in graph.features])
    feature = np.array([index[name] for f in graph.features for name in f])
    e = graph.edges
    ends, others = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    # Counts, by edge kind, of each variable's neighbours with each label; clamped ones are O.
    around = np.zeros((2, len(gold), _L))
    for kind in (0, 1):
        own = np.concatenate((e[:, 2], e[:, 2])) == kind
        np.add.at(around[kind], (ends[own], gold[others[own]]), 1)
    around[0, :, 0] += graph.walls
    weight, pair = np.zeros((len(names), _L)), np.zeros((2, _L, _L))
    sums = [np.full_like(weight, 1e-6), np.full_like(pair, 1e-6)]
    truth = np.eye(_L)[gold]
    for _ in range(rounds):
        score = np.stack([np.bincount(node, weights=weight[feature, y], minlength=len(gold)) for y in range(_L)], 1)
        score += np.einsum("kny,kyz->nz", around, pair)
        p = np.exp(score - score.max(1, keepdims=True))
        error = truth - p / p.sum(1, keepdims=True)
        up = np.stack([np.bincount(feature, weights=error[node, y], minlength=len(names)) for y in range(_L)], 1) / len(gold) - decay * weight
        both = np.einsum("kny,nz->kyz", around, error) / len(gold)
        pull = (both + both.transpose(0, 2, 1)) / 2 - decay * pair
        for value, step, total in ((weight, up, sums[0]), (pair, pull, sums[1])):
            total += step * step
            value += 0.5 * step / np.sqrt(total)
    return Field(index, weight, pair)


class Entity(NamedTuple):
    label: str
    start: int  # characters, end exclusive
    end: int
    p: float


def variables(raw: np.ndarray) -> tuple[list[tuple[int, Token]], np.ndarray, np.ndarray]:
    """The tokens of a text that are variables, with their numbers; byte starts and ends of all its tokens."""
    space = np.concatenate(([True], _SPACE[raw], [True]))
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    text = raw.tobytes()
    word = lambda k: text[starts[k] : ends[k]].decode("utf-8") if 0 <= k < len(starts) else ""
    holder = lambda at: np.searchsorted(starts, np.asarray(at, dtype=np.int64), side="right") - 1
    own = holder(np.flatnonzero(((raw >= 48) & (raw <= 57)) | (raw == 64)))
    own = set(own[np.append(True, own[1:] != own[:-1])].tolist()) if len(own) else set()
    found = set(holder([m.start() for m in _VENDORS.finditer(text)]).tolist())
    # Values of assignments: the token that begins after the sign, or goes on after it.
    for at in np.flatnonzero((raw == 58) | (raw == 61)).tolist():
        if _ASSIGNED.search(text, max(0, at - 24), at):
            k = int(holder(at)) if at + 1 < len(raw) and not _SPACE[raw[at + 1]] else int(holder(at)) + 1
            if len(word(k).rpartition(chr(raw[at]))[2].strip(_OUTSIDE)) >= 8:
                found.add(k)
            elif word(k) in ('"', "'"):
                found.add(k + 1)
    found |= {k for k in holder([m.end() for m in _BEARER.finditer(text)]).tolist() if len(bare(word(k))) >= 16}
    for k in holder([m.end() for m in _TITLED.finditer(text)]).tolist():
        for n in range(k, k + 4):  # a name has up to four parts
            if shape(word(n)) not in ("capital", "initial"):
                break
            found.add(n)
            if word(n)[-1] in ".,;:!?" and shape(word(n)) != "initial":
                break
    found = {k for k in found if 0 <= k < len(starts)}
    if keys := {key for k in found - own if (key := _key_of(word(k)))}:
        found |= {k for k in range(len(starts)) if k not in own and _key_of(word(k)) in keys}
    return [(k, Token(word(k), (word(k - 2), word(k - 1)))) for k in sorted(own | found)], starts, ends


def find_all(field: Field, texts: pa.Array) -> list[list[Entity]]:
    """Entities of every text; nulls have none."""
    out: list[list[Entity]] = []
    for lo, hi in chunks(texts):
        data, at = string_buffer(texts.slice(lo, hi - lo))
        documents, places = [], []
        for r in range(hi - lo):
            raw = data[at[r] : at[r + 1]]
            tokens, starts, ends = variables(raw)
            documents.append(tokens)
            places.append((raw, starts, ends))
        p = field.marginals(build(documents))
        base = 0
        for tokens, (raw, starts, ends) in zip(documents, places):
            p_own = p[base : base + len(tokens)]
            base += len(tokens)
            out.append(_entities(tokens, p_own, raw, starts, ends))
    return out


def _entities(tokens: list[tuple[int, Token]], p: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[Entity]:
    labels = p.argmax(1) if len(p) else np.zeros(0, dtype=int)
    if not labels.any():
        return []
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    found: list[Entity] = []
    last = -2
    for (number, token), label, own in zip(tokens, labels, p):
        if not label:
            continue
        core = bare(token.text)
        start = int(chars[starts[number]]) + len(token.text) - len(token.text.lstrip(_OUTSIDE))
        end = start + len(core)
        if found and last == number - 1 and found[-1].label == LABELS[label] and LABELS[label] in _GROUPED:
            found[-1] = found[-1]._replace(end=end, p=min(found[-1].p, float(own[label])))
        else:
            found.append(Entity(LABELS[label], start, end, float(own[label])))
        last = number
    return found


_ENTITIES = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
)


def _with_entities(docs: DataFrame, text_col: str, to: str = "__entities") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    @F.arrow_udf(_ENTITIES)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[e._asdict() for e in found] for found in find_all(shared.value, texts)], kind)

    return bounded_batches(docs).withColumn(to, find.asNondeterministic()(F.col(text_col)))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``label``, ``start``, ``end``, ``p``) of each piece of personal data; never its value.

    Offsets are in characters, the end exclusive; ``p`` is the marginal probability,
    of the least certain token where an entity has several.  Defined cases: null and
    empty texts have none; texts are read whole, however long; repeated rows are
    reported each; a null id is kept; of equally probable labels the first in
    ``LABELS`` counts; an empty table has no rows.  Other columns, whatever their
    names, are not read.
    """
    found = _with_entities(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text")), "__text")
    return found.select(id_col, F.explode("__entities").alias("e")).select(id_col, "e.label", "e.start", "e.end", F.round("e.p", 6).alias("p"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each piece of personal data replaced by ``<LABEL>``; all rows and columns stay.

    Cases as for ``entities``; a null text stays null, an empty one empty, and an
    ``n_chars`` column gets the new length.
    """
    own = "__entities"
    while own in docs.columns:
        own += "_"
    found = _with_entities(docs, text_col, own)
    e = F.col(own)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(e)),
        lambda k: F.concat(
            F.when(k == 0, "").otherwise(F.concat(F.lit("<"), e[k - 1]["label"], F.lit(">"))),
            F.substring(
                F.col(text_col),
                F.when(k == 0, 1).otherwise(e[k - 1]["end"] + 1),
                F.when(k < F.size(e), e[k]["start"]).otherwise(F.length(text_col)) - F.when(k == 0, 0).otherwise(e[k - 1]["end"]),
            ),
        ),
    )
    text = F.when(F.size(e) > 0, F.array_join(pieces, "")).otherwise(F.col(text_col))
    return with_text(found, text_col, text).drop(own)
