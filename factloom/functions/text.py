"""Markup, sentences, names and question words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of wiki markup, in the order they apply.
MARKUP = [
    (r"\{\{[^{}]*\}\}", " "),
    (r"\{\{[^{}]*\}\}", " "),
    (r"(?s)<ref[^>]*>.*?</ref>", " "),
    (r"(?s)\{\|.*?\|\}", " "),
    (r"(?m)^==+.*?==+$", " "),
    (r"(?m)^[*#:].*$", " "),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"<[^>]+>", " "),
    (r"'''+", ""),
    (r"''", ""),
    (r"&(?:[a-z]+|#\d+);", " "),
    (r"\s+", " "),
]
# Fixed words that tell nothing about a question.
STOPWORDS = [
    "the", "a", "an", "i", "you", "we", "they", "it", "this", "that",
    "is", "are", "was", "were", "be", "am", "do", "does", "did",
    "have", "has", "had", "will", "would", "should", "could", "can",
    "may", "might", "must", "to", "from", "in", "on", "at", "by",
    "for", "of", "with", "as", "and", "or", "but", "if", "so",
    "how", "what", "when", "where", "why", "which", "who", "whom",
    "whose", "my", "your", "his", "her", "its", "our", "their",
    "some", "any", "all", "no", "not", "than", "into", "out",
    "up", "down", "over", "under", "again", "very", "just", "now",
    "then", "here", "there", "also", "got", "get", "go", "going",
    "want", "need", "like", "make", "made", "use", "used", "using",
]
# Fixed patterns of a question's intent; the first that matches decides.
INTENTS = {
    "how-to": [r"^how\s+(?:do\s+i|can\s+i|to)", r"^what'?s? the way to", r"\b(?:undo|delete|remove|create|make|add|fix|amend|revert)\b"],
    "what-is": [r"^what\s+is", r"^what\s+does", r"^what'?s? a "],
    "compare": [r"\bvs\b", r"\bversus\b", r"difference between"],
    "why": [r"^why\s+", r"\bwhy\s+does\b", r"\bwhy\s+am\s+i\b"],
}


def strip_markup(text: Column) -> Column:
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def split_sentences(text: Column, low: int = 15, high: int = 600) -> Column:
    """Sentences of low to high characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'])"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s).between(low, high))


def normalize_entity(name: Column) -> Column:
    """Without possessives, and without a word said twice in a row."""
    bare = F.trim(F.regexp_replace(name, r"['’]s\b", ""))
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    start = F.array().cast("array<string>")
    kept = F.aggregate(tokens, start, lambda a, t: F.when((F.size(a) > 0) & (F.lower(F.element_at(a, -1)) == F.lower(t)), a).otherwise(F.array_append(a, t)))
    return F.array_join(kept, " ")


def stem(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(token.rlike("[sx]es$") & (n > 3), token.substr(F.lit(1), n - 2))
        .when(token.endswith("s") & (n > 3) & ~token.endswith("ss"), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def content_tokens(text: Column) -> Column:
    """Distinct stems of the words that tell something."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), F.lit(1))
    told = F.filter(raw, lambda t: (F.length(t) > 1) & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), t))
    return F.array_distinct(F.transform(told, stem))


def detect_intent(question: Column) -> Column:
    out = None
    for intent, patterns in INTENTS.items():
        hit = question.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("how-to")


# Fixed topics of a question and the words that tell them.
TOPICS = {
    "commit": ["commit", "committed", "committing"],
    "branch": ["branch", "branches", "branching"],
    "merge": ["merge", "merging", "merged"],
    "rebase": ["rebase", "rebasing", "rebased"],
    "stash": ["stash", "stashes", "stashing"],
    "remote": ["remote", "push", "pull", "fetch", "origin", "upstream"],
    "log": ["log", "history", "commits"],
    "status": ["status", "changed", "modified", "what's changed"],
    "diff": ["diff", "difference"],
    "cherry-pick": ["cherry-pick", "cherry pick", "cherrypick"],
    "head": ["head", "detached"],
    "recovery": ["lost", "recover", "missing", "deleted"],
    "tag": ["tag", "release"],
    "file": ["file", "files", "ignore", "gitignore", "untrack"],
    "setup": ["init", "initialise", "clone", "config", "setup", "configure"],
    "undo": ["undo", "revert", "rollback", "back out"],
    "conflict": ["conflict", "conflicts", "merge conflict"],
    "submodule": ["submodule"],
    "bisect": ["bisect", "find bug", "find broken"],
    "blame": ["blame", "who changed", "who wrote"],
    "worktree": ["worktree", "parallel"],
}
# Fixed moods that a question's words ask for.
MOODS = {
    "why": ["philosophical", "reflective", "anguished"],
    "what": ["philosophical", "reflective", "declaration"],
    "do you regret": ["melancholy", "reflective", "anguished"],
    "tired": ["melancholy", "weary"],
    "afraid": ["defiant", "anguished"],
    "stop": ["defiant", "oratorical", "commanding"],
    "give up": ["defiant", "oratorical"],
    "die": ["exalted", "defiant", "melancholy"],
}


def told(question: Column, table: dict[str, list[str]] = TOPICS) -> Column:
    """The table's keys, in its order, of which the question holds a word; none for null."""
    low = F.lower(question)
    hits = [F.when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), F.lit(key)) for key, words in table.items()]
    return F.array_compact(F.array(*hits))


def moods(question: Column, table: dict[str, list[str]] = MOODS) -> Column:
    """All moods of all words that the question holds, repeats included."""
    low, none = F.lower(question), F.array().cast("array<string>")
    return F.concat(*(F.when(low.contains(w), F.array(*map(F.lit, m))).otherwise(none) for w, m in table.items()))


def score_item(question: Column, tokens: Column, intent: Column, topics: Column, item: dict) -> Column:
    """How well an item (topic, intent, question_patterns) answers; its best pattern counts."""
    low, best = F.lower(question), [F.lit(0.0)]
    for pattern in map(str.lower, item["question_patterns"]):
        words = pattern.split()
        threes = [low.contains(" ".join(words[i : i + 3])) for i in range(len(words) - 2)]
        near = F.when(low.contains(pattern), 15.0)
        for t in threes:
            near = near.when(t, 5.0)
        best.append(3.0 * F.size(F.array_intersect(content_tokens(F.lit(pattern)), tokens)) + near.otherwise(0.0))
    best_pattern = F.greatest(*best) if len(best) > 1 else best[0]
    return F.when(F.array_contains(topics, item["topic"]), 3.0).otherwise(0.0) + F.when(intent == item["intent"], 1.0).otherwise(0.0) + best_pattern


def best_items(questions: DataFrame, items: list[dict], k: int = 1, column: str = "question") -> DataFrame:
    """questions with items: the k best of a small catalogue, array<struct<score, item_id>>; ties as catalogued, none at 0."""
    q = F.col(column)
    ready = questions.withColumns({"_tokens": content_tokens(q), "_intent": detect_intent(q), "_topics": told(q)})
    score = lambda item: score_item(q, F.col("_tokens"), F.col("_intent"), F.col("_topics"), item)
    scored = F.array(*(F.struct(score(x).alias("score"), F.lit(-n).alias("place"), F.lit(x["item_id"]).alias("item_id")) for n, x in enumerate(items)))
    top = F.filter(F.slice(F.sort_array(scored, asc=False), 1, k), lambda x: x["score"] > 0)
    return ready.withColumn("items", F.transform(top, lambda x: F.struct(x["score"], x["item_id"]))).drop("_tokens", "_intent", "_topics")


def score_utterance(text: Column, themes: Column, mood: Column, asked: Column, wanted: Column, used: Column) -> Column:
    """How well an utterance fits the themes asked and moods wanted; one that was used before falls behind all."""
    fits = 3.0 * F.size(F.array_intersect(themes, asked)) + F.when(F.array_contains(wanted, mood), 1.5).otherwise(0.0)
    return fits - F.when(F.array_contains(used, text), 100.0).otherwise(0.0) + F.least(F.lit(2.0), F.length(text) / 200)


def best_utterances(questions: DataFrame, catalogue: list[dict], themes: dict[str, list[str]], column: str = "question", used: Column | None = None) -> DataFrame:
    """questions with ``answer``: the text of a small catalogue (text, themes, mood) that fits best, null if none is over 0."""
    q, none = F.col(column), F.array().cast("array<string>")
    ready = questions.withColumns({"_asked": told(q, themes), "_wanted": moods(q)})
    score = lambda u: score_utterance(F.lit(u["text"]), F.array(*map(F.lit, u["themes"])).cast("array<string>"), F.lit(u["mood"]), F.col("_asked"), F.col("_wanted"), used if used is not None else none)
    scored = F.array(*(F.struct(score(u).alias("score"), F.lit(-n).alias("place"), F.lit(u["text"]).alias("text")) for n, u in enumerate(catalogue)))
    top = F.array_max(scored)
    return ready.withColumn("answer", F.when(top["score"] > 0, top["text"])).drop("_asked", "_wanted")


def respond(answer: Column, fallback: str) -> Column:
    """The answer, or a set text where there is none; ``%s`` in it stands for nothing."""
    return F.coalesce(answer, F.lit(fallback))


def wrapped(text: str, width: int = 72, indent: str = "", later: str | None = None) -> str:
    """Text in lines of a width, the first and the later ones indented."""
    import textwrap

    return textwrap.fill(text, width, initial_indent=indent, subsequent_indent=indent if later is None else later)


def format_answer(item: dict, score: float, width: int = 72) -> str:
    """An item of a catalogue as text: what it is about, its commands, what it explains and warns of."""
    parts = [f"{item['item_id']}  (score {score:.1f})"]
    parts += [f"  $ {c}" for c in item.get("commands") or []]
    parts += [wrapped(item["explanation"], width, "  ")] if item.get("explanation") else []
    parts += [wrapped(c, width, "  ! ", "    ") for c in item.get("cautions") or []]
    return "\n".join([*parts, *([f"  see also: {', '.join(item['related_items'])}"] if item.get("related_items") else [])])
