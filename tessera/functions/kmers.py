"""Canonical rolling hashes of k-mers, in numpy, one pass over a run."""

from __future__ import annotations

import re

import numpy as np

# The published ntHash seeds of A, C, G, T.
SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}

_RUN = re.compile("[ACGTacgt]+")
_OF, _COMP = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
for _base, _other in zip("ACGTacgt", "TGCAtgca", strict=True):
    _OF[ord(_base)], _COMP[ord(_base)] = SEEDS[_base.upper()], SEEDS[_other.upper()]


def rol(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64) & np.uint64(63)
    return (x << n) | (x >> ((np.uint64(64) - n) & np.uint64(63)))


def runs(seq: str | None) -> list[str]:
    """Maximal runs of A, C, G, T in either case, upper-cased."""
    return [r.upper() for r in _RUN.findall(seq or "")]


def run_hashes(run: str, k: int) -> np.ndarray:
    """Canonical hash (the lesser of both strands') of each k-mer of a run; prefix XORs make it linear."""
    n = len(run)
    if n < k:
        return np.empty(0, np.uint64)
    codes, t = np.frombuffer(run.encode(), np.uint8), np.arange(n)
    p, q = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.bitwise_xor.accumulate(rol(_OF[codes], -t % 64), out=p[1:])
    np.bitwise_xor.accumulate(rol(_COMP[codes], t % 64), out=q[1:])
    i = np.arange(n - k + 1)
    return np.minimum(rol(p[k:] ^ p[:-k], (i + k - 1) % 64), rol(q[k:] ^ q[:-k], -i % 64))


def kmer_hashes(seq: str | None, k: int) -> np.ndarray:
    """Of all runs; k-mers never span two."""
    parts = [run_hashes(r, k) for r in runs(seq)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def many_kmer_hashes(seqs: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all k-mers of many sequences, in order, in one pass: owner is the number of the sequence. The same hashes as kmer_hashes()."""
    parts = [(s or "").encode("utf-8", "surrogatepass") for s in seqs]
    codes = np.frombuffer(b"\n".join(parts), np.uint8)
    n = len(codes)
    if n < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    t = np.arange(n)
    p, q, odd = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.int64)
    forward, back = _OF[codes], _COMP[codes]
    np.cumsum(forward == 0, out=odd[1:])
    np.bitwise_xor.accumulate(rol(forward, -t % 64), out=p[1:])
    np.bitwise_xor.accumulate(rol(back, t % 64), out=q[1:])
    i = np.flatnonzero(odd[k:] == odd[:-k])  # windows without a byte that is no base
    h = np.minimum(rol(p[i + k] ^ p[i], (i + k - 1) % 64), rol(q[i + k] ^ q[i], -i % 64))
    ends = np.cumsum([len(x) + 1 for x in parts])
    return np.searchsorted(ends, i, "right"), h
