"""Fits the trees of pii.py on texts made for it: python -m quern.llm.pii_train prints pii_trees.py.

Texts are drawn with secrets, numbers to call and disguised addresses, and with things that look alike (long words, names of
variables, dates, amounts, codes); features come from the operator's own SQL. Gradient boosting with logistic loss fits
trees of depth three, whose leaves are rounded to thousandths; thresholds are the lowest scores at which at least 99.5 % of held-out candidates
above are true.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import SparkSession

from quern.llm import pii
from quern.session import build_session

N_TREES, DEPTH, RATE, MIN_LEAF, PRECISION = 16, 3, 0.5, 8, 0.995
# Forms in which people write numbers to call and of persons, a 9 for each digit.
NUMBERS = ["(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "999-99-9999", "09999 999999", "0999 999 9999", "(099) 9999 9999", "09 99 99 99 99", "09.99.99.99.99", "099 9999999", "0999-9999999", "09999 99999", "1-999-999-9999", "099 999 99 99"]
BARE_NUMBERS = ["9999999999", "9999999", "09999999999"]
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class TextMaker:
    def __init__(self, seed: int):
        self.pick = random.Random(seed)

    def word(self, low: int = 1, high: int = 4) -> str:
        p = self.pick
        return "".join(p.choice("bcdfghlmnprstv") + p.choice("aeiou") for _ in range(p.randint(low, high)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.pick.randint(low, high)))

    def digits(self, n: int) -> str:
        return "".join(self.pick.choice("0123456789") for _ in range(n))

    def filled(self, form: str) -> str:
        """form with every 9 replaced by a digit."""
        return "".join(self.pick.choice("0123456789") if c == "9" else c for c in form)

    def account(self, valid: bool = True) -> str:
        """A bank account number with its check digits, or with wrong ones."""
        p = self.pick
        country, body = p.choice(["DE", "FR", "GB", "NL", "ES", "CH", "AT"]), "".join(p.choice("0123456789" if p.random() < 0.85 else "ABCDEFGHIJ") for _ in range(p.choice([14, 16, 18, 20, 23])))
        remainder = int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        check = 98 - remainder if valid else (98 - remainder + p.randint(1, 90)) % 97 + 2
        number = f"{country}{check:02d}{body}"
        return number if p.random() < 0.4 else " ".join(number[i : i + 4] for i in range(0, len(number), 4))

    def token(self) -> str:
        p = self.pick
        alphabet = p.choice([ALNUM, ALNUM, ALNUM[:26] + ALNUM[52:], ALNUM[26:], "0123456789abcdef"])
        found = [p.choice(alphabet) for _ in range(p.randint(20, 44))]
        for needed in ("0123456789", alphabet[:6] if alphabet[0].isalpha() else "abcdef"):
            found.insert(p.randint(0, len(found)), p.choice(needed))
        return "".join(found)

    def personal(self) -> tuple[str, str, str]:
        """(text before, span, text after)."""
        p, kind = self.pick, self.pick.randrange(5)
        if kind == 3:
            cue = p.choice(["IBAN ", "IBAN: ", "account ", "pay to ", "Konto ", "transfer it to ", "", ""])
            return cue, self.account(p.random() < 0.9 or cue not in ("IBAN ", "IBAN: ")), p.choice(["", ".", ","])
        if kind == 4:
            return f"https://{self.word()}.{p.choice(['com', 'io'])}/{p.choice(['reset', 'share', 'invite', 'hooks', 'd', 's'])}/", self.token(), p.choice(["", "/", "?a=1", "."])
        if kind == 0:
            if p.random() < 0.4:
                secret = "".join(p.choice("0123456789abcdef") for _ in range(p.choice([20, 32, 40, 64])))
            else:
                secret = p.choice(["sk-", "ghp_", "AKIA", ""]) + "".join(p.choice(ALNUM) for _ in range(p.randint(20, 40)))
            cue = p.choice(['token = "', "api_key: ", 'secret="', "password=", "TOKEN=", "the key is ", "pwd: ", "Authorization: Bearer ", "key ", ""])
            return cue, secret, '"' if cue.endswith('"') else ""
        if kind == 1:
            cue = p.choice(["call ", "tel: ", "phone ", "SSN ", "contact us at ", "reach me on ", "mobile ", "fax: ", "dial "])
            bare = p.random() < 0.15
            number = self.filled(p.choice(BARE_NUMBERS if bare else NUMBERS))
            return cue if bare or p.random() < 0.65 else "", number, ""
        at, dot = p.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", "."), (" at ", " dot "), (" AT ", " DOT "), (" at ", " dot ")])
        name = f"{self.word()}{p.choice(['.', '_', ''])}{self.word()}{self.digits(p.choice([0, 0, 2]))}"
        return "", f"{name}{at}{self.word(1, 5)}{dot}{p.choice(['com', 'org', 'net', 'de', 'io', 'co', 'info'])}", ""

    def harmless(self) -> str:
        p, kind = self.pick, self.pick.randrange(22)
        return [
            lambda: self.word(9, 14) + self.digits(p.randint(1, 2)),
            lambda: "_".join([self.word(2, 3), self.word(2, 4), self.word(2, 3)]) + "_" + self.digits(1),
            lambda: f"{p.randint(1900, 2030)}{p.choice('-. ')}{p.randint(10, 12)}{p.choice('-. ')}{p.randint(10, 28)}",
            lambda: " ".join(str(p.randint(1, 99)) for _ in range(p.randint(4, 9))),
            lambda: f"{p.randint(1, 999)}.{self.digits(3)}.{self.digits(3)}.{self.digits(3)}0",
            lambda: p.choice(["", "order ", "invoice ", "id ", "item no. ", "ref: ", "serial "]) + self.digits(p.randint(7, 18)),
            lambda: f"ISBN 978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}",
            lambda: f"{p.randint(1900, 2030)}-{p.randint(1900, 2030)}",
            lambda: "/".join(self.word(2, 4) for _ in range(4)) + "/" + self.digits(2),
            lambda: f"{self.word()}{p.choice([' @ ', ' @ ', ' (at) '])}{self.word()}. {self.word()}",
            lambda: f"{self.word()}{p.choice([' @ ', ' [at] '])}{self.word()}.{self.word(2, 4)}",  # a stop without a space
            lambda: f"{p.randint(1, 999)} {self.digits(3)} {self.digits(3)}" + f" {self.digits(3)}" * p.randint(0, 1),
            lambda: f"{p.randint(0, 9)}.{self.digits(p.randint(6, 9))}",
            lambda: p.choice(["commit ", "sha256:", "SHA-1 ", "md5 ", "checksum ", "tree ", "digest: ", "revision "]) + "".join(p.choice("0123456789abcdef") for _ in range(p.choice([32, 40, 64]))),
            lambda: f"https://{self.word()}.org/{self.digits(4)}/" + "-".join(p.choice([self.word(1, 3), self.word(1, 3), self.digits(p.randint(1, 4))]) for _ in range(p.randint(5, 10))) + p.choice(["-1", "a", f"-{self.digits(4)}-b", "-" + self.word()]),
            lambda: f"https://{self.word()}.net/" + p.choice(["-", "_", ""]).join(self.word(2, 4).title() for _ in range(p.randint(3, 6))) + p.choice(["-", "_", ""]) + self.digits(p.randint(1, 8)) + p.choice(["", "", self.word(), "v"]),
            lambda: f"https://{self.word()}.net/" + "-".join([self.word(1, 2).upper(), self.digits(4), *(self.word(2, 3).title() for _ in range(3)), self.digits(2)]),
            lambda: f"/{self.word()}/" + "_".join(self.word(2, 4) for _ in range(4)) + self.digits(2),
            lambda: self.account(valid=False),
            lambda: f"{p.choice(['AB', 'XK', 'PN'])}{self.digits(2)} {self.word(2, 2).upper()[:4]} {self.digits(4)} {self.digits(4)}",
            lambda: f"{self.word()} at {self.word(2, 4)}.{p.choice(['com', 'org', self.word(1, 2)])}",
            lambda: f"{self.word()} at {self.word(1, 3)}. {self.word()}",
        ][kind]()

    def text(self) -> tuple[str, list[tuple[int, int]]]:
        parts, spans, at = [], [], 0
        for _ in range(self.pick.randint(1, 4)):
            lead = self.words(1, 8) + " "
            before, span, after = self.personal() if self.pick.random() < 0.45 else ("", "", self.harmless())
            if span:
                begin = at + len(lead) + len(before)
                spans.append((begin, begin + len(span)))
            parts.append(lead + before + span + after + " ")
            at += len(parts[-1])
        return "".join(parts) + self.words(1, 5), spans


def labelled(spark: SparkSession, seed: int, texts: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    maker = TextMaker(seed)
    made = [maker.text() for _ in range(texts)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    found: dict[str, list] = {k: [] for k in pii.EXTRA}
    for row in pii.candidates(frame, "text", ["doc_id"]).select("doc_id", "extra").collect():
        for c in row["extra"]:
            truth = any(abs(a - c["start"]) <= 1 and abs(b - c["end"]) <= 1 for a, b in made[row["doc_id"]][1])
            found[c["kind"]].append((c["f"], truth))
    return {k: (np.array([f for f, _ in rows], dtype=float), np.array([t for _, t in rows], dtype=float)) for k, rows in found.items()}


def _split(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, threshold) of the best split of some rows."""
    best = None
    base = slope[rows].sum() ** 2 / (curve[rows].sum() + 1.0)
    for feature in range(x.shape[1]):
        for threshold in np.unique(x[rows, feature])[:-1]:
            left = rows[x[rows, feature] <= threshold]
            right = rows[x[rows, feature] > threshold]
            if len(left) < MIN_LEAF or len(right) < MIN_LEAF:
                continue
            gain = slope[left].sum() ** 2 / (curve[left].sum() + 1.0) + slope[right].sum() ** 2 / (curve[right].sum() + 1.0) - base
            if best is None or gain > best[0]:
                best = (gain, feature, int(threshold))
    return best if best and best[0] > 1e-6 else None


def fit(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    names, score, trees = list(pii.FEATURES), np.zeros(len(y)), []

    def grow(rows: np.ndarray, depth: int):
        split = _split(x, slope, curve, rows) if depth else None
        if split is None:
            leaf = round(1000 * RATE * slope[rows].sum() / (curve[rows].sum() + 1.0))
            score[rows] += leaf / 1000
            return leaf
        _, feature, threshold = split
        return names[feature], threshold, grow(rows[x[rows, feature] <= threshold], depth - 1), grow(rows[x[rows, feature] > threshold], depth - 1)

    for _ in range(N_TREES):
        chance = 1 / (1 + np.exp(-score))
        slope, curve = y - chance, chance * (1 - chance)
        trees.append(grow(np.arange(len(y)), DEPTH))
    return trees


def scores(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    names = list(pii.FEATURES)

    def walk(node, row) -> int:
        while not isinstance(node, int):
            node = node[2] if row[names.index(node[0])] <= node[1] else node[3]
        return node

    return np.array([sum(walk(t, row) for t in trees) for row in x])


def calibrate(score: np.ndarray, truth: np.ndarray) -> int:
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((share >= PRECISION) & last)
    return int(score[order][good[-1]]) - 1 if len(good) else int(score.max())


def main() -> None:
    spark = build_session(4, 4)
    train, held, final = labelled(spark, 1, 2500), labelled(spark, 2, 1500), labelled(spark, 3, 1500)
    print('"""Boosted trees of pii.py as pii_train prints them: (feature, threshold, at most, more), leaves in thousandths."""\n\nTREES = {')
    thresholds = {}
    for kind in pii.EXTRA:
        trees = fit(*train[kind])
        thresholds[kind] = calibrate(scores(trees, held[kind][0]), held[kind][1])
        chosen, truth = scores(trees, final[kind][0]) > thresholds[kind], final[kind][1] > 0
        print(f'    "{kind}": [  # held-out precision {truth[chosen].mean():.3f}, recall {chosen[truth].mean():.3f} of {len(truth)} candidates')
        print("\n".join(f"        {t!r}," for t in trees) + "\n    ],")
    print("}\n\nTHRESHOLDS = {" + ", ".join(f'"{k}": {v}' for k, v in thresholds.items()) + "}")


if __name__ == "__main__":
    main()
