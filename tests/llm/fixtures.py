"""Small tables with the awkward rows: nulls, blanks, copies, near copies, long and periodic texts."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 70)
    for i in range(n):
        text = prose(rng, rng.choice([3, 15, 40, 120, 300]))
        if i % 5 == 1 and i > 5:
            text = rows[rng.randrange(len(rows))][1]
        if i % 7 == 2:
            text = text + "\n" + passage + " " + prose(rng, 10)
        if i % 6 == 3 and i > 5:
            words = (rows[rng.randrange(len(rows))][1] or "").split()
            if len(words) > 30:
                words[rng.randrange(len(words))] = "edited"
            text = "  ".join(words)
        if i % 11 == 4:
            text = prose(rng, 5) + " " + "again " * rng.choice([19, 20, 21, 50]) + prose(rng, 4)
        if i % 13 == 5:
            text = prose(rng, 25) + " x " + " ".join(["a b c"] * 30)
        rows.append((i, text, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None, "t\t"][i % 5], 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s1", 0), (n + 3, passage, "en", "s9", 1), (None, passage + " null id", "en", "s1", 2)]
    rows += [rows[0], (3, "same id other text " + passage, "en", "s0", 0)]
    return rows
