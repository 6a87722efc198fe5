"""What a model is told. The first part never changes within a version, so that a provider can cache it."""

from __future__ import annotations

VERSION = "1"

SYSTEM = """You decide how call sites of one HTTP library move to another. You see clusters: groups of sites that look
alike in shape and signature, each shown by a few samples with numbered lines. One answer serves a whole cluster, so
answer only what holds for all its members.

For each cluster write its name and then lines of these kinds, nothing else:
CLUSTER <name>
ACTION set_timeout value=<seconds>
ACTION map_exception from=<old dotted name> to=<new dotted name>
ACTION rename_symbol from=<old dotted name> to=<new dotted name>
NOTE <one short sentence>
ESCALATE <why no action fits>

set_timeout is for calls that give no timeout: the old library waits for ever, the new one for five seconds. Choose from
what the function does: minutes where a job runs unattended, seconds where somebody waits. map_exception replaces the
type an except clause names. rename_symbol replaces a dotted name wherever it stands. Actions run in order. Where none of
them is right for every member, write ESCALATE: a wrong rule is applied to every member, a refusal costs one question."""

CLOSING = "Answer every cluster above, each once."

#: The rules a whole-file request needs, as nothing else states them.
NAIVE_SYSTEM = (
    """You move Python files from one HTTP library to another and return each file whole. Change nothing but what the
move needs; keep comments, names and layout.

Imports: replace the plain import of the old library by that of the new one. Keep the order of imports.
Calls: get, post, put, patch, delete, head, options and request keep their names under the new library's name.
Arguments: allow_redirects becomes follow_redirects. params, json, data, headers, cookies, auth and timeout stay.
Redirects: the old library follows them unless told not to, the new one does not unless told to.
Sessions: a Session becomes a Client. Its methods stay. Close it, or use it in a with statement.
Timeouts: the old library waits for ever where no timeout is given, the new one for five seconds. Give a timeout
wherever none is given: a long one in jobs that run unattended, a short one where somebody waits for the answer.
Errors: the types are sorted differently. ConnectionError becomes ConnectError. Timeout becomes TimeoutException.
HTTPError becomes HTTPStatusError, which only raise_for_status raises. RequestException becomes HTTPError, the base of all
errors of transport and status. TooManyRedirects keeps its name. Do not widen or narrow what an except clause catches
beyond this.
Responses: text, content, json, headers, status_code and raise_for_status stay. ok becomes is_success. iter_content becomes
iter_bytes and needs a stream; iter_lines stays.
Streams: stream=True becomes a with statement over the new library's stream function.
Proxies, certificates and adapters are arguments of the client in the new library, never of one call.
Files: uploads stay as they are, but open files must be binary.
Cookies: per-call cookies are deprecated; set them on the client.
Encodings: the old library guesses them, the new one takes UTF-8 unless a header says otherwise.
"""
    "Check the result: it must parse, must not name the old library anywhere but in comments and strings, must give every "
    "call a timeout, and must not have an argument the new library does not know. Return the file alone, without a "
    "word before or after it."
)
NAIVE_CLOSING = "Return the whole file as it is after the move."

#: (keys, code, answer): approved decisions, shown where a cluster is similar enough.
LIBRARY = [
    (["ambiguous_timeout", "call", "get", "params", "fn:batch"], "def weekly_bulk_copy(url):\n    return requests.get(url, params=WANTED)", "ACTION set_timeout value=120.0\nNOTE runs unattended"),
    (["ambiguous_timeout", "call", "get", "params", "fn:interactive"], "def profile(url):\n    return requests.get(url, params=WANTED)", "ACTION set_timeout value=10.0\nNOTE somebody waits"),
    (["ambiguous_retry", "except", "requests.exceptions.ConnectionError", "requests.exceptions.Timeout", "in_loop", "in_try"], "    except requests.exceptions.Timeout:\n        continue", "ACTION map_exception from=requests.exceptions.Timeout to=httpx.TimeoutException\nNOTE the loop stays"),
    (["ambiguous_status", "except", "requests.exceptions.HTTPError", "in_try"], "    except requests.exceptions.HTTPError:\n        return None", "ACTION map_exception from=requests.exceptions.HTTPError to=httpx.HTTPStatusError\nNOTE only raise_for_status raises it"),
]
