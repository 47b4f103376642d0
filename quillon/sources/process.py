"""Run a scanner as a child process, on the driver."""

from __future__ import annotations

import subprocess
import threading
from dataclasses import dataclass

#: Seconds between two looks at the cancel signal.
LOOK_S = 0.1


@dataclass(frozen=True)
class ProcessOutput:
    exit_code: int
    stdout: str
    stderr: str


def run_process(command: str, arguments: list[str], timeout_s: float | None = None, cwd: str | None = None, env: dict[str, str] | None = None, cancel: threading.Event | None = None) -> ProcessOutput:
    """Run without a shell and without standard input, and return all output.

    A non-zero exit is returned, not raised. A process that outlives ``timeout_s`` or whose ``cancel`` is set is terminated
    and reports -1, as does one ended by a signal; no limit if ``timeout_s`` is missing or 0. A signal set before the start
    ends the process too. A command that can't be started raises OSError.
    """
    child = subprocess.Popen([command, *arguments], cwd=cwd, env=env, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    done = threading.Event()
    if cancel is not None:

        def watch() -> None:
            while not done.is_set():
                if cancel.wait(LOOK_S):
                    if not done.is_set():
                        child.terminate()
                    return

        threading.Thread(target=watch, daemon=True).start()
    try:
        out, err = child.communicate(timeout=timeout_s or None)
    except subprocess.TimeoutExpired:
        child.terminate()
        out, err = child.communicate()
    finally:
        done.set()
    code = child.returncode
    return ProcessOutput(code if code is not None and code >= 0 else -1, out.decode("utf-8", "replace"), err.decode("utf-8", "replace"))
