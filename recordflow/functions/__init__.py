from recordflow.functions import jsonx, text

__all__ = ["jsonx", "text"]
