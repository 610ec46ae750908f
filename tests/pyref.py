"""Plain-Python reference implementations used by the tests (brute force:
dictionary n-gram counts and the textbook O(n*m) LCS table)."""

import math
import re
from collections import Counter

from proselab.functions.stem import porter_stem


def rouge_tokens(text, stem=False):
    toks = [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9]+", " ", (text or "").lower())) if t]
    if stem:
        toks = [porter_stem(t) if len(t) > 3 else t for t in toks]
    return toks


def ngrams(toks, n):
    return Counter(tuple(toks[i : i + n]) for i in range(len(toks) - n + 1))


def f1(ov, hc, rc):
    p = ov / max(hc, 1)
    r = ov / max(rc, 1)
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, 1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def rouge(ref, hyp, stem=False):
    r, h = rouge_tokens(ref, stem), rouge_tokens(hyp, stem)
    out = []
    for n in (1, 2):
        rc, hc = ngrams(r, n), ngrams(h, n)
        ov = sum((rc & hc).values())
        out.append(f1(ov, sum(hc.values()), sum(rc.values())))
    if not r or not h:
        out.append(0.0)
    else:
        lcs = lcs_dp(r, h)
        p, q = lcs / len(h), lcs / len(r)
        out.append(0.0 if p + q == 0 else 2 * p * q / (p + q))
    return tuple(out)


def bleu4(ref, hyp):
    r, h = ref.split(), hyp.split()
    nums, dens = [], []
    for n in (1, 2, 3, 4):
        hc, rc = ngrams(h, n), ngrams(r, n)
        nums.append(sum(min(c, rc[g]) for g, c in hc.items()))
        dens.append(max(1, len(h) - n + 1))
    if nums[0] == 0:
        return 0.0
    ps = [(0.1 / d) if k == 0 else k / d for k, d in zip(nums, dens)]
    c, rl = len(h), len(r)
    bp = 1.0 if c > rl else (0.0 if c == 0 else math.exp(1 - rl / c))
    return bp * math.exp(math.fsum(0.25 * math.log(p) for p in ps))
