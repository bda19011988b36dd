"""Two small greenhouse tables used as golden inputs, built by rule: a clean baseline and a degraded batch."""

BEDS, CROPS, NEW_CROPS = ("north", "east", "south", "west"), ("Basil", "Chard", "Kale"), ("Kale", "Mizuna")


def _csv(rows: list[tuple]) -> str:
    lines = ["day,bed,height,water,crop,growth,sold", *(",".join("" if v is None else str(v) for v in r) for r in rows)]
    return "\n".join(lines) + "\n"


def _base() -> list[tuple]:
    """40 readings, four beds a day for ten days; nothing missing, repeated or out of line."""
    return [(f"2025-03-{1 + i // 4:02d}", BEDS[i % 4], round(20 + 0.7 * i + 0.3 * (i % 4), 2), 500 + 13 * (i % 29), CROPS[i % 3],
             round(0.2 + 0.01 * ((7 * i) % 40), 3), i % 2) for i in range(40)]


def _new() -> list[tuple]:
    """30 later readings with gaps, two repeated rows, one flood and one jump, a new crop, and hardly an unsold tray."""
    rows = []
    for i in range(28):
        water = None if i % 7 == 3 else 9000 if i == 20 else 800 + 11 * i
        crop = None if i % 9 == 4 else NEW_CROPS[i % 2]
        growth = 4.5 if i == 11 else round(0.5 + 0.01 * ((5 * i) % 28), 3)
        rows.append((f"2025-04-{1 + i // 4:02d}", BEDS[i % 4], round(61 + 0.9 * i, 2), water, crop, growth, 0 if i == 9 else 1))
    return [*rows, rows[5], rows[5]]


BASE_ROWS, NEW_ROWS = _base(), _new()
BASE, NEW = _csv(BASE_ROWS), _csv(NEW_ROWS)
