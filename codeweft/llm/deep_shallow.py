"""Deep-shallow sorting of suffixes, and what their order says about repeats on both sides of an anchor.

Suffixes are byte strings of one width, filled up with zeros, with their true lengths; a shorter one precedes a longer one that
is equal to it when filled up.
"""

from __future__ import annotations

from bisect import bisect_left, insort

WORD_BYTES = 8


def common(a: int, b: int, width: int) -> int:
    """How many leading bytes two strings of ``width`` bytes, as big-endian integers, share."""
    return width - ((a ^ b).bit_length() + 7) // 8


def order(items: list[bytes], numbers: list[int], lengths: list[int], start: int, shallow: int) -> list[int]:
    """The places of ``items`` in lexicographic order. numbers: the items as big-endian integers. All share ``start`` bytes
    in most inputs; words from there on are sorted to the depth ``shallow``, and deeper ties go to blind tries."""
    out: list[int] = []

    def multikey(places: list[int], at: int) -> None:
        """Multikey quicksort: parts the strings by one word into less, equal and greater; equal ones go on to the next word."""
        todo = [(places, at)]
        while todo:
            places, at = todo.pop()
            if len(places) == 1:
                out.append(places[0])
            elif at >= shallow:
                out.extend(blind_order(places, items, numbers, lengths))
            elif places:
                keys = {i: items[i][at : at + WORD_BYTES] for i in places}
                pivot = sorted(keys[i] for i in (places[0], places[len(places) // 2], places[-1]))[1]
                todo.append(([i for i in places if keys[i] > pivot], at))
                todo.append(([i for i in places if keys[i] == pivot], at + WORD_BYTES))
                todo.append(([i for i in places if keys[i] < pivot], at))

    multikey([*range(len(items))], start if len({x[:start] for x in items}) == 1 else 0)
    return out


def blind_order(places: list[int], items: list[bytes], numbers: list[int], lengths: list[int]) -> list[int]:
    """Orders strings with a long common prefix through a blind trie: inner nodes hold only the depth at which strings part
    and the byte of each branch. An insertion goes down without comparing, compares with the one leaf it meets, and
    branches off where that comparison says."""
    width = len(items[places[0]])
    root: list = [places[0]]  # a leaf: the places of equal strings; an inner node: (depth, {byte: node})
    for new in places[1:]:
        s, node, path = items[new], root, []
        while isinstance(node, tuple):
            path.append(node)
            branches = node[1]
            node = branches.get(s[node[0]]) or next(iter(branches.values()))
        depth = common(numbers[new], numbers[node[0]], width)
        if depth == width:
            node.append(new)
            continue
        above = [n for n in path if n[0] < depth]
        below = path[len(above)] if len(above) < len(path) else node
        if isinstance(below, tuple) and below[0] == depth:
            below[1][s[depth]] = [new]
            continue
        fork = (depth, {items[node[0]][depth]: below, s[depth]: [new]})
        if above:
            above[-1][1][s[above[-1][0]]] = fork
        else:
            root = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += sorted(node, key=lengths.__getitem__)
    return out


def shared_ranges(contexts: list[tuple[bytes, bytes]], length: int, gram: int) -> list[tuple[int, int]]:
    """contexts: for each of several different places of one anchor, the bytes before it in reverse and the bytes from it on.

    For each place, (lo, hi): of the strings of ``length`` bytes that start t bytes before the anchor, lo the least and hi the
    greatest t at which another place has an equal one; (length, -1) if there is none.

    Nodes of the suffixes' prefix tree are visited from the deepest up. A node of depth d holds places that share d bytes
    from the anchor on; its places are kept in order of what precedes the anchor, where the longest agreement is with a
    neighbour. The smaller of two sets is put into the larger, and only new neighbours are compared.
    """
    n, back = len(contexts), length - gram
    left, right = [c[0].ljust(back, b"\0") for c in contexts], [c[1].ljust(length, b"\0") for c in contexts]
    l_len, r_len = [len(c[0]) for c in contexts], [len(c[1]) for c in contexts]
    l_num, r_num = [int.from_bytes(x) for x in left], [int.from_bytes(x) for x in right]
    suffixes = order(right, r_num, r_len, gram, gram + 2 * WORD_BYTES)
    rank = [0] * n
    by_left = order(left, l_num, l_len, 0, 2 * WORD_BYTES)
    for k, i in enumerate(by_left):
        rank[i] = k
    lo, hi = [length] * n, [-1] * n

    def meet(x: int, y: int, least: int) -> None:
        i, j = by_left[x], by_left[y]
        t = min(common(l_num[i], l_num[j], back), l_len[i], l_len[j])
        if t >= least:
            for k in (i, j):
                lo[k] = min(lo[k], least)
                hi[k] = max(hi[k], t)

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        least = max(0, length - depth)
        for x in b:
            at = bisect_left(a, x)
            if at:
                meet(a[at - 1], x, least)
            if at < len(a):
                meet(x, a[at], least)
            insort(a, x)
        return a

    # intervals of the longest common prefixes of neighbours, closed from the inside out with a stack
    stack: list[tuple[int, list[int]]] = []
    held = [rank[suffixes[0]]]
    for k in range(1, n):
        i, j = suffixes[k - 1], suffixes[k]
        depth = min(common(r_num[i], r_num[j], length), r_len[i], r_len[j])
        while stack and stack[-1][0] >= depth:
            d, more = stack.pop()
            held = join(more, held, d)
        stack.append((depth, held))
        held = [rank[j]]
    while stack:
        d, more = stack.pop()
        held = join(more, held, d)
    return [*zip(lo, hi, strict=True)]
