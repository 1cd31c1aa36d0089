"""What a language model is told before a listing of posts: the task, what each field of an answer may hold, and worked answers in the layout that is read back."""

from __future__ import annotations

import json

from tonelake.schemas import DRIVERS, HORIZONS, LEVELS, NOVELTY, SECTOR_CODES

FIELDS = ("item_id", "direction", "magnitude", "confidence", "level", "sector_code", "ticker", "driver", "novelty", "horizon", "summary")
LEGACY_FIELDS = ("item_id", "summary", "sentiment_score", "scope", "topic")


def answer(item_id: str, summary: str, **judged: object) -> dict[str, object]:
    """An entry with every field; those not judged are null."""
    return {name: judged.get(name) for name in FIELDS} | {"item_id": item_id, "summary": summary}


#: Posts and the entries that fit them.
EXAMPLES = (
    (
        "The trial of our lung drug was stopped early, the board says: no benefit over placebo. We will not file this year.",
        answer("a", "Lung drug trial stopped, no filing this year", direction=-1, magnitude=3, confidence=0.95, level="stock", sector_code="bio_pharma", driver="other", novelty="new", horizon="medium"),
    ),
    (
        "Does anyone still have the slides from the spring conference?",
        answer("b", "Asks for slides, says nothing about a market"),
    ),
    (
        "Parliament passed the bill tonight: grid fees may rise with costs from January, the cap of 2 % a year is gone.",
        answer("c", "Cap of 2 % a year on grid fees lifted from January", direction=1, magnitude=2, confidence=0.8, level="sector", sector_code="utility", driver="regulation", novelty="new", horizon="medium"),
    ),
    (
        "Monthly review. Department stores sold 4 % less in May than a year before, as reported on the 9th; we had written about it then.",
        answer("d", "May sales of department stores were 4 % lower", direction=-1, magnitude=1, confidence=0.7, level="sector", sector_code="retail", driver="earnings", novelty="recap", horizon="short"),
    ),
    (
        "Copper inventories at the exchange fell by a third, while two smelters restart next week; hard to say which will weigh more.",
        answer("e", "Copper stocks down a third, two smelters restart", direction=0, magnitude=2, confidence=0.35, level="macro", driver="commodity", novelty="new", horizon="short"),
    ),
)


def one_of(values: tuple[str, ...]) -> str:
    return " | ".join(values)


def instruction() -> str:
    """The text that goes before a listing."""
    fields = {
        "item_id": "as in the listing",
        "direction": "1 if the news lifts prices, -1 if it weighs on them, 0 if it does neither or both",
        "magnitude": "how much: 0 nothing, 1 little, 2 plainly, 3 strongly",
        "confidence": "0 to 1, for direction and magnitude together",
        "level": f"what it is about: {one_of(LEVELS)}",
        "sector_code": f"with level {LEVELS[2]} or {LEVELS[3]}: {one_of(SECTOR_CODES)}",
        "ticker": "six digits, only where the post leaves no doubt which company it is",
        "driver": f"why: {one_of(DRIVERS)}",
        "novelty": f"{NOVELTY[0]} if it could not be known before, {NOVELTY[1]} if it goes over what happened, {NOVELTY[2]} if it passes on another's post",
        "horizon": f"for how long it counts: {one_of(HORIZONS)}",
        "summary": "one line, with the post's own figures",
    }
    worked = [f"Post [{entry['item_id']}]: {text}\nEntry: {json.dumps(entry)}" for text, entry in EXAMPLES]
    return "\n\n".join([
        "Judge how posts of research channels bear on prices. Give one JSON object, {\"items\": [...]}, with an entry for each post of the listing.",
        "\n".join(f"{name}: {meaning}" for name, meaning in fields.items()),
        "What a post does not tell is null, which does not mean 0. A post without anything to judge keeps item_id and a summary that says so.",
        *worked,
    ])


def legacy_instruction() -> str:
    """The text that goes before a listing for the old single score."""
    fields = {
        "item_id": "as in the listing",
        "summary": "one or two sentences",
        "sentiment_score": "from -5 (very bad for prices) over 0 to 5 (very good), fractions allowed",
        "scope": one_of(LEVELS),
        "topic": "a word or two",
    }
    return "\n\n".join([
        "Sum up posts of research channels and give each one score. Give one JSON object, {\"items\": [...]}, and leave out posts that say nothing about a market.",
        "\n".join(f"{name}: {meaning}" for name, meaning in fields.items()),
    ])
