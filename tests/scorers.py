"""Stand-in models; a file of its own, so that Python workers can import it."""

import os
import time

from textguard.operators.second_pass import ScorerUnavailable


def bad_words(name):
    def run(prompts):
        assert name == "m1"
        if prompts.str.contains("down").any():
            raise ScorerUnavailable
        return prompts.map(lambda p: " Malicious.\n" if "bad" in p else "safe")

    return run


def broken(name):
    return lambda prompts: 1 / 0


def evil(name):
    return lambda prompts: prompts.map(lambda p: "MALICIOUS" if "evil" in p else "SAFE")


def everything(name):
    return lambda prompts: prompts.map(lambda p: "malicious")


def by_name(name):
    """Condemns the texts that hold the model's own name."""
    return lambda prompts: prompts.map(lambda p: "MALICIOUS" if name in p else "SAFE")


def hanging(name):
    """Waits for ever for one text, and answers the others."""

    def run(prompts):
        if prompts.str.contains("hang").any():
            time.sleep(3600)
        return prompts.map(lambda p: "MALICIOUS")

    return run


def unmade(name):
    raise ScorerUnavailable


def fleeting(name):
    return lambda prompts: os._exit(3)
