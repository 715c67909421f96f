"""Forward-backward over many chains at once, exact for chains of any length.

Chains are cut into blocks that advance side by side, one position at a time.  What a block does to the
vector that enters it is one matrix, the product of its steps; the matrices carry the forward vector
from block to block of a chain, and the backward vector back.  Then every block is entered with the
vector of its whole chain, so the marginals are those of whole chains.  With many labels the
matrices would cost more than they save, and a chain is one block.
"""

from __future__ import annotations

import numpy as np

from itemforge.llm import textkit as tk

BLOCK = 64
#: Labels up to which chains are cut into blocks.
FEW = 16


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = x.sum(1, keepdims=True)
    return x / s, s[:, 0]


def forward_backward(e: np.ndarray, off: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(marginals by position, expected moves, expected firsts, log of the total weight of all chains).

    ``e``: weight of each label at each position; ``off``: offsets of the chains (empty ones are none);
    ``move``: weight of a label after another; ``first``: weight of a label at the start.
    """
    n, k = e.shape
    if n == 0:
        return e.copy(), np.zeros((k, k)), np.zeros(k), 0.0
    kind = e.dtype
    move, first = move.astype(kind), first.astype(kind)
    size = np.diff(off)
    chain_at, size = off[:-1][size > 0], size[size > 0]
    length = BLOCK if k <= FEW else int(size.max())
    count = -(-size // length)
    number = tk.spread(np.zeros(len(count), np.int64), count)
    at = np.repeat(chain_at, count) + number * length
    left = np.minimum(length, np.repeat(size, count) - number * length)
    opens, closes = number == 0, number == np.repeat(count, count) - 1
    order = np.argsort(-left, kind="stable")  # a block's place among the sorted ones is its rank
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    at, left, opens, closes = at[order], left[order], opens[order], closes[order]
    lead = rank[np.cumsum(count) - count]
    levels = [rank[(np.cumsum(count) - count)[count > j] + j] for j in range(int(count.max()))]
    active = np.searchsorted(-left, -np.arange(int(left[0])), side="left")

    enter = np.zeros((len(at), k), dtype=kind)
    enter[lead] = first
    leave = np.ones((len(at), k), dtype=kind)
    log = np.float64(0.0)
    if len(levels) > 1:
        many = np.flatnonzero(~(opens & closes))  # blocks of chains with several, still sorted by length
        m_at, m_opens = at[many], opens[many]
        live = np.searchsorted(-left[many], -np.arange(int(left[many[0]])), side="left")
        step = np.where(m_opens[:, None, None], np.eye(k, dtype=kind), move) * e[m_at][:, None, :]
        for t in range(1, len(live)):
            a = live[t]
            now = (step[:a].reshape(-1, k) @ move).reshape(a, k, k) * e[m_at[:a] + t][:, None, :]
            step[:a] = now / now.sum((1, 2), keepdims=True)
        whole = np.zeros((len(at),), dtype=np.int64)
        whole[many] = np.arange(len(many))
        for j in range(len(levels) - 1):  # forward from block j to the next
            there = levels[j + 1]
            here = rank[order[there] - 1]
            enter[there] = _unit(np.einsum("bi,bij->bj", enter[here], step[whole[here]]))[0]
        for j in range(len(levels) - 1, 0, -1):  # and back
            there = levels[j]
            here = rank[order[there] - 1]
            leave[here] = _unit(np.einsum("bij,bj->bi", step[whole[there]], leave[there]))[0]

    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = enter
    for t, a in enumerate(active):
        now = (np.where(opens[:a, None], now[:a], now[:a] @ move) if t == 0 else now[:a] @ move) * e[at[:a] + t]
        now, s = _unit(now)
        log += np.log(s.astype(np.float64)).sum()
        alpha[at[:a] + t] = now
    now = leave[:0]
    for t in range(len(active) - 1, -1, -1):
        a, had = active[t], len(now)
        back = leave[:a].copy()
        if had:
            back[:had] = _unit((now * e[at[:had] + t + 1]) @ move.T)[0]
        now = back
        beta[at[:a] + t] = now
    gamma = _unit(alpha * beta)[0]
    inner = np.ones(n, dtype=bool)
    inner[chain_at + size - 1] = False
    here = np.flatnonzero(inner)
    ahead = e[here + 1] * beta[here + 1]
    z = ((alpha[here] @ move) * ahead).sum(1, keepdims=True)
    moves = move.astype(np.float64) * (alpha[here].T @ (ahead / z)).astype(np.float64)
    return gamma, moves, gamma[chain_at].sum(0, dtype=np.float64), float(log)
