"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The field scores whole segments of a text: the features of a candidate look at all of
it (how many digits in which groups, checksums, an at-sign and a dot, what stands left and right), and dynamic programming
over segments of bounded length chooses boundaries and kinds together. It finds forms that the patterns miss, such as
defanged addresses, `name (at) host (dot) com` or phone numbers without a plus. What it finds beside the base spans is added.

A segment must hold a seed (a digit, an at-sign, an `(at)`), so the text falls apart into regions around seeds that are
decoded one by one with the result of decoding it whole, and a text without seeds is done.

The weights are fitted by gradient ascent on the likelihood of known forms, generated by rules and set into contexts from a
bounded sample of the texts. No label column is read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: A candidate has at most so many tokens and characters.
MAX_TOKENS, MAX_CHARS = 24, 64
#: Texts that lend contexts for training, about, and examples made from them.
SAMPLE_TEXTS, EXAMPLES, EPOCHS = 200, 500, 5

SEED = re.compile(r"[0-9@]|[(\[{]at[)\]}]")
SEED_SQL = r"[0-9@]|[(\[{]at[)\]}]"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, sorted. Each kind is searched in time linear in the text."""
    out = []
    # email: a local part ends at an at-sign and starts after the match before; the leftmost match begins at its first character.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    # ip: four numbers at a time from each dotted row of numbers.
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((place, 1, place + n))
            place += n + 1
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field ---------------------------------------------------------------------------------------------------------

AT = re.compile(r"@|\s*[(\[{]at[)\]}]\s*")
DOT = re.compile(r"\.|\s*[(\[{]\.[)\]}]\s*|\s*[(\[{]dot[)\]}]\s*")
GROUPS = re.compile(r"[0-9]+")
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\s*[(\[{]at[)\]}]\s*)[A-Za-z0-9-]+(?:(?:\.|\s*[(\[{](?:\.|dot)[)\]}]\s*)[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]{1,3}(?:(?:\.|[(\[{](?:\.|dot)[)\]}])[0-9]{1,3}){3}")
NUMBER = re.compile(r"\+?[0-9(][0-9() .\-]*[0-9]")
FEATURES = ["bias", "digits_0", "digits_1_6", "digits_7_8", "digits_9_11", "digits_12_15", "digits_16_19", "digits_more",
            "luhn", "octets", "address", "quad", "number", "plus", "paren", "fours", "ends_3_4", "ends_4", "groups_1", "groups_2",
            "groups_3_5", "groups_more", "date", "space", "newline", "dot", "dash", "letters", "glued_left", "glued_right",
            "joined_left", "joined_right", "plus_left", "at"]
INDEX = {f: i for i, f in enumerate(FEATURES)}


def span_features(text: str, a: int, b: int) -> list[int]:
    """Indices of the features that hold for the whole candidate text[a:b]."""
    s, on = text[a:b], ["bias"]
    groups = GROUPS.findall(s)
    n = sum(map(len, groups))
    on.append("digits_0" if not n else "digits_1_6" if n < 7 else "digits_7_8" if n < 9 else "digits_9_11" if n < 12
              else "digits_12_15" if n < 16 else "digits_16_19" if n < 20 else "digits_more")
    if 12 <= n <= 19 and luhn("".join(groups)):
        on.append("luhn")
    if len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups):
        on.append("octets")
    on += [f for f, p in (("address", ADDRESS), ("quad", QUAD), ("number", NUMBER)) if p.fullmatch(s)]
    if groups:
        on.append("groups_1" if len(groups) == 1 else "groups_2" if len(groups) == 2 else "groups_3_5" if len(groups) < 6 else "groups_more")
        lengths = [len(g) for g in groups]
        if set(lengths) == {4} and len(lengths) > 2:
            on.append("fours")
        if lengths[-2:] == [3, 4]:
            on.append("ends_3_4")
        elif lengths[-1] == 4:
            on.append("ends_4")
        if lengths in ([4, 2, 2], [2, 2, 4]):
            on.append("date")
    on += [f for f, c in (("paren", "("), ("newline", "\n"), ("dot", "."), ("dash", "-"), ("space", " ")) if c in s]
    if s[0] == "+":
        on.append("plus")
    if AT.search(s):
        on.append("at")
    if any(c.isalpha() for c in s):
        on.append("letters")
    left, right = text[a - 1:a], text[b:b + 1]
    if left.isalnum():
        on.append("glued_left")
    if right.isalnum():
        on.append("glued_right")
    if left and left in "+":
        on.append("plus_left")
    if left and left in ".-@_%" and text[a - 2:a - 1].isalnum():
        on.append("joined_left")
    if right and right in ".-@_%" and text[b + 1:b + 2].isalnum():
        on.append("joined_right")
    return [INDEX[f] for f in on]


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no candidate leaves, around the seeds; they begin and end between tokens."""
    start = end = None
    for m in SEED.finditer(text):
        a, b = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield start, end
        start, end = a, b
    if end is not None:
        yield start, end


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], dict[int, list[tuple[int, list[int]]]]]:
    """Token boundaries of a region, and per last boundary the segments (first boundary, features) that may be an entity.

    A segment starts with a letter, a digit, a plus or an opening bracket, ends with a letter, a digit or a bracket, and
    holds a seed.
    """
    while 0 < lo < len(text) and text[lo - 1].isalnum() and text[lo].isalnum():
        lo -= 1
    while 0 < hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
        hi += 1
    cuts = [lo]
    for m in TOKEN.finditer(text, lo, hi):
        cuts.append(m.end())
    seeded = np.zeros(len(cuts), "int64")
    place = {c: i for i, c in enumerate(cuts)}
    for m in SEED.finditer(text, lo, hi):
        i = place.get(m.start())
        if i is not None:
            seeded[i] += 1
    # A digit inside a run of digits is no boundary of its own, but the run's first digit is.
    total = np.concatenate(([0], np.cumsum(seeded)))
    ends: dict[int, list[tuple[int, list[int]]]] = {}
    for i in range(len(cuts) - 1):
        c = text[cuts[i]]
        if not (c.isalnum() or c in "+("):
            continue
        for j in range(i + 1, min(len(cuts), i + MAX_TOKENS + 1)):
            if cuts[j] - cuts[i] > MAX_CHARS:
                break
            last = text[cuts[j] - 1]
            if last.isalnum() and total[j] > total[i]:
                ends.setdefault(j, []).append((i, span_features(text, cuts[i], cuts[j])))
    return cuts, ends


class Field:
    """weights[k, f] for kinds; a token outside an entity scores 0. follow[k] scores an entity right behind another."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray):
        self.weights, self.follow = weights, follow

    def scored(self, ends: dict) -> dict[int, list[tuple[int, np.ndarray]]]:
        return {j: [(i, self.weights[:, f].sum(axis=1)) for i, f in own] for j, own in ends.items()}

    def decode(self, cuts: list[int], ends: dict) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, kind, end)."""
        n, scores = len(cuts), self.scored(ends)
        best = np.full((n, 2), -np.inf)  # best[j, e]: up to boundary j, whether an entity ends there
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        best[0, 0] = 0
        for j in range(1, n):
            before = int(best[j - 1].argmax())
            best[j, 0], back[j, 0] = best[j - 1, before], (j - 1, before, -1)
            for i, s in scores.get(j, ()):
                for e in (0, 1):
                    own = s + self.follow * e
                    k = int(own.argmax())
                    if best[i, e] + own[k] > best[j, 1]:
                        best[j, 1], back[j, 1] = best[i, e] + own[k], (i, e, k)
        out, at = [], (n - 1, int(best[n - 1].argmax()))
        while at[0]:
            i, e, k = back[at]
            if k >= 0:
                out.append((cuts[i], k, cuts[at[0]]))
            at = (i, e)
        return out[::-1]

    def gradient(self, ends: dict, n: int, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood of the gold entities (first boundary, kind, last boundary): observed minus expected."""
        scores = self.scored(ends)
        fwd, bwd = np.full((n, 2), -np.inf), np.full((n, 2), -np.inf)
        fwd[0, 0] = 0
        for j in range(1, n):
            fwd[j, 0] = np.logaddexp(*fwd[j - 1])
            for i, s in scores.get(j, ()):
                for e in (0, 1):
                    if fwd[i, e] > -np.inf:
                        fwd[j, 1] = np.logaddexp(fwd[j, 1], fwd[i, e] + np.logaddexp.reduce(s + self.follow * e))
        starts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for j, own in scores.items():
            for i, s in own:
                starts.setdefault(i, []).append((j, s))
        bwd[n - 1] = 0
        for i in range(n - 2, -1, -1):
            for e in (0, 1):
                bwd[i, e] = bwd[i + 1, 0]
                for j, s in starts.get(i, ()):
                    bwd[i, e] = np.logaddexp(bwd[i, e], np.logaddexp.reduce(s + self.follow * e) + bwd[j, 1])
        z = np.logaddexp(*fwd[n - 1])
        dw, df, like = np.zeros_like(self.weights), np.zeros_like(self.follow), -z
        ended = {j for _, _, j in gold}
        for j, own in ends.items():
            for (i, f), (_, s) in zip(own, scores[j]):
                for e in (0, 1):
                    p = np.exp(fwd[i, e] + s + self.follow * e + bwd[j, 1] - z)
                    dw[:, f] -= p[:, None]
                    df -= p * e
                for k in range(len(KINDS)):
                    if (i, k, j) in gold:
                        dw[k, f] += 1
                        df[k] += i in ended
                        like += s[k] + self.follow[k] * (i in ended)
        return dw, df, like


def invented(kind: int, rng: random.Random) -> str:
    """A made-up entity in one of its usual forms."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(3, 8)))
    if kind == 0:
        local = word() + rng.choice(["", "." + word(), "." + num(2), "_" + num(1)])
        at, dot = rng.choice([("@", "."), ("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", ".")])
        return local + at + dot.join([word(), *[word()] * rng.randint(0, 1), rng.choice(["com", "net", "org", "de"])])
    if kind == 1:
        return rng.choice([".", ".", "[.]", "(.)", "[dot]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + num(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-", "."])
        return sep.join(body[i:i + 4] for i in range(0, 16, 4))
    a, b, c = num(3), num(3), num(4)
    return rng.choice([f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(2)} {num(3)} {num(4)}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}",
                       f"+1-{a}-{b}-{c}"])


def decoy(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        str(rng.randint(1, 9)), str(rng.randint(1900, 2099)), f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", num(6), num(9),
        f"20{num(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)},{num(3)}", f"{num(2)}.{num(2)}",
        "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"v{num(1)}.{num(1)}", f"{num(2)}:{num(2)}", f"@{num(3)}", f"#{num(4)}",
        "$" * 3 + num(2), num(16), f"{num(4)} {num(4)} {num(3)}", f"(at) {num(2)}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", num(24), f"a@b {num(2)}"])


def examples(contexts: list[str], n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    rng = random.Random(seed)
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += rng.choice(contexts) + rng.choice([" ", " ", "\n", ": ", ", "])
            if rng.random() < 0.6:
                kind = rng.randrange(len(KINDS))
                entity = invented(kind, rng)
                gold.append((len(text), kind, len(text) + len(entity)))
                text += entity
            else:
                text += decoy(rng)
            text += rng.choice([" ", " ", ". ", ", ", "\n", "!! "])
        yield text + rng.choice(contexts), gold


def train(contexts: list[str], n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 10, rate: float = 0.3) -> Field:
    field = Field(np.zeros((len(KINDS), len(FEATURES))), np.zeros(len(KINDS)))
    field.weights[:, 0] = -4.0
    data = []
    for text, gold in examples(contexts, n, seed):
        for lo, hi in regions(text):
            cuts, ends = candidates(text, lo, hi)
            place = {c: i for i, c in enumerate(cuts)}
            own = {(place[a], k, place[b]) for a, k, b in gold if a in place and b in place and cuts[0] <= a and b <= cuts[-1]}
            data.append((ends, len(cuts), own))
    square_w, square_f = np.full_like(field.weights, 1e-6), np.full_like(field.follow, 1e-6)
    order = random.Random(seed + 1)
    for _ in range(epochs):
        order.shuffle(data)
        for ends, size, own in data:
            dw, df, _ = field.gradient(ends, size, own)
            dw -= 1e-4 * field.weights
            square_w += dw * dw
            square_f += df * df
            field.weights += rate * dw / np.sqrt(square_w)
            field.follow += rate * df / np.sqrt(square_f)
    return field


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    return [x for lo, hi in regions(text) for x in field.decode(*candidates(text, lo, hi))]


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and with them the field's spans that touch none of these."""
    base = base_spans(text)
    free = [x for x in field_spans(text, field) if not any(a < x[2] and x[0] < b for a, _, b in base)]
    return base, sorted(base + free)


def contexts_of(docs: DataFrame, text_col: str, texts: int = SAMPLE_TEXTS, width: int = 40) -> list[str]:
    """Short stretches without seeds from about `texts` texts, chosen by hash; always with some plain ones of its own."""
    plain = ["", "call me at", "my mail is", "send it to", "the number"]
    mark = F.xxhash64(text_col)
    docs = docs.where(F.col(text_col).isNotNull())
    n = docs.count()
    share = int(min(1.0, texts / max(n, 1)) * (1 << 53))
    stretch = F.substr(text_col, F.pmod(mark, F.greatest(F.length(text_col) - 20 * width, F.lit(1))).cast("int") + 1, F.lit(20 * width))
    rows = (docs.where(F.shiftrightunsigned(mark, 11) < share).groupBy(mark.alias("mark"))
            .agg(F.min(stretch).alias("t")).orderBy("mark").limit(2 * texts).collect())
    pieces = [p for r in rows for p in re.findall(rf"(?s).{{{width}}}", r["t"]) if not SEED.search(p)]
    return plain + pieces


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: int = SAMPLE_TEXTS) -> DataFrame:
    """One row per document: id, base and spans, arrays of (kind, start, end) in code points, end exclusive, sorted by start and kind.

    A null text counts as empty and has no spans. Null and repeated ids are kept as they are. Other columns are not read. An
    empty table gives no rows.
    """
    field = train(contexts_of(docs, text_col, texts))
    span = "array<struct<kind:string,`start`:bigint,`end`:bigint>>"

    @F.pandas_udf(f"base {span}, spans {span}")
    def find(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in column:
            rows = [([], []) if t is None else all_spans(t, field) for t in batch]
            yield pd.DataFrame({name: [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in r[i]] for r in rows]
                                for i, name in enumerate(("base", "spans"))})

    seeded = F.when(F.col(text_col).rlike(SEED_SQL), F.col(text_col))
    return docs.select(F.col(id_col), find(seeded).alias("found")).select(id_col, "found.base", "found.spans")


def joined(spans: str) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
