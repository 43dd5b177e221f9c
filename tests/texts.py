"""Small corpora for the tests."""

USE = "This document is intended only for the use of"
LONG = USE + " the individual or entity to which it is addressed"
NOTIFY = "Please notify the sender immediately by e-mail if you have received this communication in error"

#: LONG then NOTIFY in three documents, NOTIFY alone in one more, USE in other places, and noise.
NOTICES = [
    f"alpha one. {LONG}. {NOTIFY}.",
    f"beta two. {LONG}. {NOTIFY}!",
    f"gamma three. {LONG}. {NOTIFY}.",
    f"delta four. {NOTIFY}. closing words here",
    f"epsilon five. {LONG}, says six. And seven again: {LONG} eight.",
    f"zeta nine. {USE} our staff.",
    "Short doc.",
    "Nothing in this one is found anywhere else at all",
]

#: A phrase whose starts others cover: of "r s", "p q r s" and "u v r s".
COVERED = ["p q r s a0", "p q r s a1", "u v r s a2", "u v r s a3", "p q b0", "p q b1", "p q b2", "u v c0", "u v c1", "u v c2"]


def brute_closed(token_lists, least, shortest, unit="occurrences", left=True):
    """{phrase: (occurrences, documents)} by looking at every phrase of every length."""
    from collections import defaultdict

    seen = defaultdict(list)
    for d, t in enumerate(token_lists):
        for a in range(len(t)):
            for b in range(a + shortest, len(t) + 1):
                seen[tuple(t[a:b])].append((d, t[a - 1] if a else None, t[b] if b < len(t) else None))
    out = {}
    for phrase, rows in seen.items():
        docs = {d for d, _, _ in rows}
        if (len(rows) if unit == "occurrences" else len(docs)) < least:
            continue
        if unit == "occurrences":
            sides = [{p for _, p, _ in rows}] * left + [{n for _, _, n in rows}]
            if any(len(s) == 1 and None not in s for s in sides):
                continue
        else:
            after = defaultdict(set)
            for d, _, n in rows:
                if n is not None:
                    after[n].add(d)
            if any(len(x) == len(docs) for x in after.values()):
                continue
        out[" ".join(phrase)] = (len(rows), len(docs))
    return out
