import re


def word_list(text):
    """The words of the contracts: A-Z lower-cased, runs of non-space bytes."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
