"""The query-sharing DAG of ranked search: which sums of term scores several
items have in common, so that each is added up once per document.

Leaves are the co-occurrence classes: all terms that occur in exactly the same
items are one leaf. Inner nodes add two nodes that stand side by side in at
least two items (leaves ordered by how many items hold them); rounds of such
replacements go on until no pair repeats. An item is the sum of the few nodes
left of it, and every node adds disjoint terms, so integer sums stay exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class SharingPlan:
    terms: list[str]  # ordered by class
    leaf: np.ndarray  # class of each term
    left: np.ndarray  # children of the inner nodes, numbered behind the leaves
    right: np.ndarray
    rounds: np.ndarray  # first inner node of each round, and their number
    nodes: np.ndarray  # nodes of all items, item by item
    starts: np.ndarray  # first of each item's nodes

    @property
    def n_leaves(self) -> int:
        return int(self.leaf[-1]) + 1 if len(self.leaf) else 0

    def evaluate(self, leaves: np.ndarray) -> np.ndarray:
        """Items x documents from leaves x documents: every node once."""
        first = self.n_leaves
        acc = np.empty((first + len(self.left), leaves.shape[1]), np.int64)
        acc[:first] = leaves
        for lo, hi in zip(self.rounds[:-1], self.rounds[1:]):
            acc[first + lo:first + hi] = acc[self.left[lo:hi]] + acc[self.right[lo:hi]]
        return np.add.reduceat(acc[self.nodes], self.starts, axis=0)


def classes(items: np.ndarray, terms: np.ndarray) -> tuple[list[str], np.ndarray, list[tuple[int, ...]]]:
    """Terms ordered by class, the class of each, and the items of each class,
    classes of many items first. Input: the distinct (item, term) pairs."""
    order = np.lexsort((items, terms))
    items, terms = items[order], terms[order]
    first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, int)
    holders = [tuple(h.tolist()) for h in np.split(items, first[1:])] if len(terms) else []
    of_class = sorted(set(holders), key=lambda h: (-len(h), h))
    number = {h: i for i, h in enumerate(of_class)}
    leaf = np.array([number[h] for h in holders], np.int64)
    by_class = np.argsort(leaf, kind="stable")
    return [terms[first[i]] for i in by_class], leaf[by_class], of_class


def mine(items: np.ndarray, terms: np.ndarray, n_items: int) -> SharingPlan:
    """The plan of items 0 .. n_items-1 from their distinct (item, term) pairs;
    every item has a term."""
    listed, leaf, of_class = classes(items, terms)
    node = np.repeat(np.arange(len(of_class)), [len(h) for h in of_class])
    item = np.array([i for h in of_class for i in h], np.int64)
    order = np.lexsort((node, item))
    node, item = node[order], item[order]
    left, right, rounds, total = [], [], [0], len(of_class)
    while len(node) > 1:
        side = item[1:] == item[:-1]
        key = np.where(side, node[:-1] * total + node[1:], -1)
        found, back, count = np.unique(key, return_inverse=True, return_counts=True)
        count[found < 0] = 0
        # The rank of each place's pair: more frequent pairs first. A place is
        # taken if it outranks the places that overlap it.
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((found, count))] = np.arange(len(found))
        mine_, own = np.where(count[back] > 1, rank[back], -1), np.full(len(key) + 2, -1)
        own[1:-1] = mine_
        taken = (mine_ >= 0) & (mine_ > own[:-2]) & (mine_ > own[2:])
        again = np.bincount(back[taken], minlength=len(found)) > 1
        taken &= again[back]
        if not taken.any():
            break
        new = np.flatnonzero(np.bincount(back[taken], minlength=len(found)))
        left.append(found[new] // total)
        right.append(found[new] % total)
        name = np.full(len(found), -1, np.int64)
        name[new] = total + np.arange(len(new))
        at = np.flatnonzero(taken)
        node = node.copy()
        node[at] = name[back[at]]
        stay = np.ones(len(node), bool)
        stay[at + 1] = False
        node, item = node[stay], item[stay]
        total += len(new)
        rounds.append(rounds[-1] + len(new))
    none = np.zeros(0, np.int64)
    return SharingPlan(listed, leaf, np.concatenate([none, *left]), np.concatenate([none, *right]), np.array(rounds),
                       node, np.searchsorted(item, np.arange(n_items)))
