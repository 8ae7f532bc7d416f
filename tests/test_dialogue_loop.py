"""Every transcript of the dialogue loop against a plain loop over single dialogues."""

import hashlib
import math
import re

import pytest

from cairnlake.operators import bm25, constraints, dialogue
from cairnlake.operators.providers import hashed_embedding, with_embedding

KINDS = ["Horror", "Comedy, Drama", "Science Fiction", "Western", "Action, Thriller", "Family"]
ITEMS = [(i, f"Title {i % 37}", f"{KINDS[i % 6]} from {1970 + i} about {['dogs', 'ships', 'kings', 'robots'][i % 4]} number n{i} made in {KINDS[i % 6].split(',')[0]}", 1970 + i, KINDS[i % 6], None if i % 5 == 0 else ["red", "blue"][i % 2]) for i in range(40)]
WORDS = [(w, i) for i, w in enumerate(["no horror", "from the 80s", "in Action, Thriller", "plain words", "around 1999"])]


def pick(pool, seed, *ids):
    ticket = hashlib.md5(":".join(map(str, (seed, *ids))).encode()).hexdigest()
    return pool[int((int(ticket[:12], 16) + 0.5) / 2**48 * len(pool))]


def found(text, wanted, banned, embed, k=10):
    """Item ids in the order of the base score; years and genres as the text says."""
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs = {i[0]: tokens(i[2]) for i in ITEMS}
    df, avg = {}, sum(map(len, docs.values())) / len(docs)
    for t in docs.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    low = high = None
    if m := re.search(constraints.DECADE, wanted):
        low, high = 1900 + int(m[1]), 1909 + int(m[1])
    elif m := re.search(constraints.YEAR, wanted):
        low, high = int(m[1]) - 2, int(m[1]) + 2
    out = {g for p in re.findall(constraints.NEGATIVE, wanted) for k_, g in constraints.EXCLUDED.items() if k_ in p.strip().lower()}
    listed = (m[1] if (m := re.search(constraints.POSITIVE, wanted)) else "").lower()
    need = {g for k_, g in constraints.REQUIRED.items() if k_ in listed}
    words = lambda t: re.findall(r"\w+", t.lower())
    holds = lambda item, g: f" {' '.join(words(g))} " in f" {' '.join(words(item[4]))} "
    ok = [i for i in ITEMS if (low is None or low <= i[3] <= high) and not any(w in words(i[4]) for g in out for w in words(g)) and (not need or any(holds(i, g) for g in need)) and i[0] not in banned]
    q = embed([text])[0]
    size = math.sqrt(sum(x * x for x in q))
    vectors = dict(zip([i[0] for i in ok], embed([i[2] for i in ok]), strict=True))
    cos = {i: (1 + sum(x / size * y for x, y in zip(q, v, strict=True))) / 2 for i, v in vectors.items()}
    near = sorted(cos, key=lambda i: (-round(cos[i], 9), i))[: 3 * k]
    raw = {}
    for i in near:
        for w in tokens(text):
            if tf := docs[i].count(w):
                idf = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                raw[i] = raw.get(i, 0) + max(idf, 1e-6 if idf <= 0 else idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg))
    low_raw, high_raw = (min(raw.values()), max(raw.values())) if raw else (0, 0)
    norm = {i: (r - low_raw) / (high_raw - low_raw) if high_raw > low_raw else 0.0 for i, r in raw.items()}
    base = {i: 0.3 * norm.get(i, 0.0) + 0.7 * cos[i] for i in near}
    return sorted(near, key=lambda i: (-round(base[i], 9), near.index(i)))[:k]


def talk(did, target, banned, rules, embed):
    item = ITEMS[target]
    seed, said, facts, refusals, gone, shown, turns = rules.seed, [], [], [], set(), 0, 1
    text = f"Bot: {pick(dialogue.GREETINGS, seed, did, 0)}\n"
    attributes = list(rules.attributes)
    for r in range(1, rules.max_rounds + 1):
        question = None
        if r <= rules.max_questions and rules.mode == "free":
            question, reply = pick(dialogue.QUESTIONS, seed, did, r), " ".join(item[2].split()[4 * (r - 1) : 4 * r])
        elif r <= min(rules.max_questions, len(attributes)):
            label, value = rules.attributes[attributes[r - 1]], {"year": str(item[3]), "colour": item[5]}[attributes[r - 1]]
            question, reply = f"What is your preference for {label}?", f"I would like {value} for {label}." if value else dialogue.NO_PREFERENCE
            facts += [f"{label} {value}"] if value else []
        if question:
            said.append(reply)
            turns += 1
            text += f"Bot: {question}\nUser: {reply}\n"
        heard, refused = " ".join(said), "".join(f" I do not want: {x}" for x in refusals)
        query = heard + refused if rules.mode == "free" else " ".join(facts) + refused
        fresh = [i for i in found(query, query if rules.mode == "free" else heard, banned, embed) if i not in gone]
        if fresh:
            offer = ITEMS[fresh[0]]
            shown, turns = shown + 1, turns + 1
            yes = offer[1] == item[1]
            reply = f'Yes, "{item[1]}" is what I want.' if yes else pick(dialogue.REFUSALS, seed, did, r, "offer")
            text += f"Bot: {pick(dialogue.OFFERS, seed, did, r, 'offer').replace('{}', offer[1])}\nUser: {reply}\n"
            said.append(reply)
            if yes:
                return ("success", turns, shown, r, text + f"System: <END> Session ended successfully. The target item '{item[1]}' ({target}) was accepted by the user.")
            refusals.append(reply)
            gone.add(fresh[0])
        if shown >= rules.max_shown or r == rules.max_rounds:
            break
    ending = "within the maximum recommendation attempts." if shown >= rules.max_shown else "before the dialogue round limit (max_total_rounds) was reached."
    return ("max_shown" if shown >= rules.max_shown else "max_rounds", turns + 1, shown, r, text + f"System: <FAILED> Session ended. The target item '{item[1]}' ({target}) was not found {ending}")


@pytest.mark.parametrize("rules", [dialogue.Rules(max_questions=2, max_shown=3, max_rounds=4), dialogue.Rules(mode="static", max_questions=2, max_shown=2, max_rounds=3, attributes={"year": "year", "colour": "colour"})])
def test_every_transcript(spark, rules):
    items = with_embedding(spark.createDataFrame(ITEMS, "item_id long, title string, text string, year int, category string, colour string"), "text", "vector").cache()
    index = bm25.build_index(items.selectExpr("item_id AS doc_id", "text"))
    banned = {k: [1, 2, 3] if k % 3 == 0 else None for k in range(25)}
    tasks = [(f"d{k}", k, (k * 7) % 40, banned[k]) for k in range(25)] + [("lost", 1, 999, None)]
    got = {r["dialogue_id"]: r for r in dialogue.simulate(spark.createDataFrame(tasks, "dialogue_id string, user_id long, target_id long, excluded_ids array<bigint>"), items, index, rules=rules).collect()}
    assert len(got) == len(tasks) and (got["lost"]["status"], got["lost"]["turns"], got["lost"]["shown"]) == ("target_not_found", 2, 0)
    embed = hashed_embedding()
    for did, _, target, _ in tasks[:-1]:
        r = got[did]
        assert (r["status"], r["turns"], r["shown"], r["rounds"], r["transcript"]) == talk(did, target, set(banned[int(did[1:])] or ()), rules, embed)
