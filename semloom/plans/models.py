"""Model cards: prices, speed, quality and abilities of the models that a provider offers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields

from .policy import Policy


@dataclass(frozen=True)
class ModelCard:
    name: str
    usd_per_input_token: float
    usd_per_output_token: float
    seconds_per_output_token: float
    quality: float  # 0 to 100
    reads: frozenset[str] = frozenset({"text"})
    embeds: bool = False
    context_chars: int | None = None
    aggregates: bool = True
    usd_per_image_token: float | None = None  # None: as text
    usd_per_audio_token: float | None = None

    def __str__(self) -> str:
        return self.name


#: Cards of the local providers; ``register`` adds others.
CARDS: dict[str, ModelCard] = {}


def register(card: ModelCard) -> ModelCard:
    CARDS[card.name] = card
    return card


def register_cards(rows: Iterable) -> list[ModelCard]:
    """Cards from a table's rows (or dicts): the card's fields by name, ``reads`` as a list; fields that are missing or null keep their defaults."""
    out = []
    for row in rows:
        given = {k: v for k, v in (row.asDict() if hasattr(row, "asDict") else dict(row)).items() if v is not None}
        unknown = set(given) - {f.name for f in fields(ModelCard)}
        if unknown:
            raise ValueError(f"a model card has no {sorted(unknown)}")
        out.append(register(ModelCard(**given | ({"reads": frozenset(given["reads"])} if "reads" in given else {}))))
    return out


def registered() -> tuple[ModelCard, ...]:
    """All cards, for a stage's function to take along: workers know only the bundled ones."""
    return tuple(CARDS.values())


class Model:
    """Names of the bundled cards."""

    LARGE = register(ModelCard("local-large", 5e-6, 2e-5, 0.020, 85.0, frozenset({"text", "image", "audio"})))
    MEDIUM = register(ModelCard("local-medium", 1e-6, 4e-6, 0.012, 74.0, frozenset({"text", "image"})))
    SMALL = register(ModelCard("local-small", 1e-7, 4e-7, 0.005, 60.0))
    SHORT = register(ModelCard("local-short", 5e-8, 2e-7, 0.004, 52.0, context_chars=24_000, aggregates=False))
    EMBED = register(ModelCard("local-embed", 2e-8, 0.0, 0.001, 60.0, embeds=True))


def get_model(name: str | ModelCard) -> ModelCard:
    """The card of a name: exact, else the only one whose name contains it."""
    if isinstance(name, ModelCard):
        return name
    if name in CARDS:
        return CARDS[name]
    near = [c for n, c in CARDS.items() if name.lower() in n.lower()]
    if len(near) == 1:
        return near[0]
    raise KeyError(f"no model {name!r} among {sorted(CARDS)}")


def choose_models(cards: list[ModelCard], policy: Policy, keep: int = 5) -> list[ModelCard]:
    """The ``keep`` cards with the best weighted min-max scores under the policy's weights."""
    cards = [c for c in cards if not c.embeds]

    def scaled(value, best_low: bool):
        values = [value(c) for c in cards]
        low, high = min(values), max(values)
        return {c.name: 1.0 if high == low else ((high - value(c)) if best_low else (value(c) - low)) / (high - low) for c in cards}

    cost = scaled(lambda c: c.usd_per_input_token + c.usd_per_output_token, True)
    time = scaled(lambda c: c.seconds_per_output_token, True)
    quality = scaled(lambda c: c.quality, False)
    w = policy.weights
    total = {n: w["cost"] * cost[n] + w["time"] * time[n] + w["quality"] * quality[n] for n in cost}
    return sorted(cards, key=lambda c: (-total[c.name], c.name))[:keep]
