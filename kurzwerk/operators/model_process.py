"""A model in a child process of its own, replaced when a call outlasts its time limit.

A call that hangs, in Python or in native code, cannot be ended from within its process.
So the worker of a task keeps the model in a child, sends it texts through pipes and kills
it when the limit has passed; the next call starts a new one. A child whose worker is gone
ends itself.
"""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import threading
import time
from collections.abc import Callable
from typing import BinaryIO

from pyspark import cloudpickle

HEAD = struct.Struct("<Q")
COMMAND = "from kurzwerk.operators.model_process import serve; serve()"


class ModelError(RuntimeError):
    """What went wrong in the child, as ``type: message``."""


def described(exc: Exception) -> str:
    return str(exc) if isinstance(exc, ModelError) else f"{type(exc).__name__}: {exc}"


class ModelProcess:
    """``load(**limits)`` in a child; a call takes texts and gives one summary each.

    ``seconds`` limits a call, whatever its number of texts; loading has no limit, and an
    error of loading is raised by the first call after it. Not for use by several threads.
    """

    def __init__(self, load: Callable, limits: dict[str, int], seconds: float) -> None:
        self.start_message = cloudpickle.dumps((load, limits))
        self.seconds = seconds
        self.child: subprocess.Popen | None = None
        self.start()

    def start(self) -> None:
        env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
        self.child = subprocess.Popen(
            [sys.executable, "-c", COMMAND],
            stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=env, bufsize=0,
        )
        try:
            self.answer_to(self.start_message, None)
        except ModelError:
            self.close()
            raise

    def __call__(self, texts: list[str]) -> list[str]:
        if self.child is None:
            self.start()
        return self.answer_to(pickle.dumps(texts), self.seconds)

    def answer_to(self, message: bytes, seconds: float | None):
        until = None if seconds is None else time.monotonic() + seconds
        try:
            write_all(self.child.stdin, HEAD.pack(len(message)) + message)
            (size,) = HEAD.unpack(self.read(HEAD.size, until))
            good, value = pickle.loads(self.read(size, until))
        except TimeoutError:
            self.close()
            raise ModelError(f"TimeoutError: no answer within {seconds:g} s") from None
        except (EOFError, OSError):
            code = self.close(grace=1.0)
            raise ModelError(f"ModelProcessEnded: exit code {code}") from None
        if not good:
            raise ModelError(value)
        return value

    def read(self, size: int, until: float | None) -> bytes:
        out, source = bytearray(), self.child.stdout.fileno()
        waiting = select.poll()
        waiting.register(source, select.POLLIN)
        while len(out) < size:
            left = None if until is None else max(0.0, until - time.monotonic()) * 1000
            if not waiting.poll(left):
                raise TimeoutError
            part = os.read(source, min(size - len(out), 1 << 20))
            if not part:
                raise EOFError
            out += part
        return bytes(out)

    def close(self, grace: float = 0.0) -> int | None:
        """End the child, after ``grace`` seconds by force; its exit code."""
        child, self.child = self.child, None
        if child is None:
            return None
        child.stdin.close()
        try:
            code = child.wait(grace)
        except subprocess.TimeoutExpired:
            child.kill()
            code = child.wait()
        child.stdout.close()
        return code


def write_all(target: BinaryIO, data: bytes) -> None:
    view = memoryview(data)
    while view:
        view = view[target.write(view) :]


def read_exactly(source: BinaryIO, size: int) -> bytes:
    data = source.read(size)
    if len(data) < size:
        os._exit(0)  # the worker is gone
    return data


def end_with(parent: int) -> None:
    while os.getppid() == parent:
        time.sleep(1)
    os._exit(0)


def serve() -> None:
    """The child: load the model, then answer calls until the worker closes the pipe."""
    threading.Thread(target=end_with, args=(os.getppid(),), daemon=True).start()
    source = os.fdopen(0, "rb", closefd=False)
    # What a model prints goes to the log and not between the answers.
    target = os.fdopen(os.dup(1), "wb", buffering=0)
    os.dup2(2, 1)
    model = None
    while True:
        (size,) = HEAD.unpack(read_exactly(source, HEAD.size))
        message = pickle.loads(read_exactly(source, size))
        try:
            if model is None:
                load, limits = message
                model, value = load(**limits), None
            else:
                value = list(model(message))
            answer = pickle.dumps((True, value))
        except Exception as exc:  # noqa: BLE001 - told to the worker, which makes it a row value
            answer = pickle.dumps((False, f"{type(exc).__name__}: {exc}"))
        write_all(target, HEAD.pack(len(answer)) + answer)
