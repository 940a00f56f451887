"""Reward functions as a user writes them in a file of their own; loaded by path, not imported."""


def row_reward(value, event_type, scale=1.0):
    good = 0.0 if event_type == "error" else 1.0
    return {"overall": scale * value * good, "format": good, "accuracy": value}


def batch_reward(value, event_type, scale=1.0):
    most = max(value)
    return [{"overall": scale * (v - most), "format": float(e != "error"), "accuracy": v} for v, e in zip(value, event_type, strict=True)]
