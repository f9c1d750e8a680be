"""Made-up prose for the small fixtures."""


def prose(seed, n=60):
    import random

    r = random.Random(seed)
    parts = ["an", "er", "th", "on", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)) + "."
