"""The segmentation rules applied one by one to a whole text, without pieces, memory or pruning."""

from seglattice.schema import BEGIN_ID, OUTSIDE_COST, UNKNOWN_BASE, USER_BASE


def tokenize(d, text, ignore_space=False, max_grouping=0):
    cats = [d.categories_of(ord(c)) for c in text]
    n, space = len(text), d.category_id("SPACE")

    def run(i):
        j = i + 1
        while j < n and set(cats[j]) & set(cats[i]):
            j += 1
        return j

    nodes = [(0, BEGIN_ID, 0, 0, 0, None)]  # start, id, right id, end, cost, node before
    linked = {0: [0]}

    def add(i, e, word, left, right, cost):
        best = min(linked[i], key=lambda p: (nodes[p][4] + edge(nodes[p][2], left), -p))
        nodes.append((i, word, right, e, nodes[best][4] + edge(nodes[best][2], left) + cost, best))
        linked.setdefault(e, []).append(len(nodes) - 1)

    def edge(right, left):
        return d.matrix.cost(right, left)

    for i in range(n):
        if i not in linked:
            continue
        if ignore_space and space in cats[i]:
            for p in reversed(list(linked[i])):
                linked.setdefault(run(i), []).append(p)
            continue
        matched = False
        for base, own in ((USER_BASE, d.user), (0, d.entries)):
            for k, e in enumerate(own):
                if e.surface and text.startswith(e.surface, i):
                    matched = True
                    add(i, i + len(e.surface), base + k, e.left_id, e.right_id, e.word_cost)
        base = d.categories[cats[i][0]]
        if matched and not base.invoke:
            continue
        made, size = False, run(i) - i
        group = base.group and (not max_grouping or size - 1 <= max_grouping)
        own = [(UNKNOWN_BASE + k, u) for k, u in enumerate(d.unknown) if u.category_id == cats[i][0]]
        for word, u in own:
            for k in ([size] if group else []) + [k for k in range(1, min(base.length, size) + 1) if not (group and k == size)]:
                add(i, i + k, word, u.left_id, u.right_id, u.word_cost)
                made = True
        if not matched and not made:
            word, left, right, cost = (own[0][0], own[0][1].left_id, own[0][1].right_id, own[0][1].word_cost) if own else (UNKNOWN_BASE, 0, 0, 10000)
            add(i, i + 1, word, left, right, cost)
    if not text:
        return []
    order = {p: k for k, p in enumerate(linked[n])}
    p = min(order, key=lambda p: (nodes[p][4], nodes[p][1], -order[p]))
    out = []
    while nodes[p][5] is not None:
        out.append((nodes[p][0], nodes[p][3], nodes[p][1], nodes[p][4]))
        p = nodes[p][5]
    return out[::-1]
