"""Depth-first walk of JSON texts that labels every node with pre-order and post-order numbers."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))')
_WORDS = {"true": True, "false": False, "null": None}
_BLANK = re.compile(r"[ \t\n\r]*")


class _Invalid(ValueError):
    pass


class Number(str):
    """A number as it stands in the text, so that neither digits nor exponents are lost."""


def _refuse(name: str):
    raise _Invalid(name)


def _pairs(text: str):
    """`text` as nested lists and dicts without recursion, for texts nested too deeply for the standard parser."""
    at, stack, root, end = 0, [], [], len(text)
    want, key, holder = "value", None, root  # holder: the container that gets the next value

    def put(value):
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    while True:
        if want == "after" and not stack:
            break
        m = _TOKEN.match(text, at)
        if not m:
            raise _Invalid(at)
        at = m.end()
        mark, string, scalar = m.groups()
        if want in ("value", "value or ]"):
            if mark in ("{", "["):
                new = {} if mark == "{" else []
                put(new)
                stack.append((holder, key))
                holder, want = new, "key or }" if mark == "{" else "value or ]"
            elif mark == "]" and want == "value or ]":
                holder, key = stack.pop()
                want = "after"
            elif mark:
                raise _Invalid(at)
            else:
                put(json.loads(string) if string else _WORDS[scalar] if scalar in _WORDS else Number(scalar))
                want = "after"
        elif want in ("key", "key or }"):
            if mark == "}" and want == "key or }":
                holder, key = stack.pop()
                want = "after"
            elif string:
                key, want = json.loads(string), "colon"
            else:
                raise _Invalid(at)
        elif want == "colon":
            if mark != ":":
                raise _Invalid(at)
            want = "value"
        elif mark == ",":
            want = "key" if isinstance(holder, dict) else "value"
        elif mark == ("}" if isinstance(holder, dict) else "]"):
            holder, key = stack.pop()
        else:
            raise _Invalid(at)
    if _BLANK.match(text, at).end() != end:
        raise _Invalid(at)
    return root[0]


def parse(text: str | None):
    """(True, value) of a strictly valid JSON text, else (False, None); a text that is one JSON string holding an
    object or array stands for what it holds. A repeated key keeps its last value; numbers are kept as they are written."""
    if not text:
        return False, None

    def strict(s):
        try:
            return json.loads(s, parse_constant=_refuse, parse_int=Number, parse_float=Number)
        except RecursionError:
            return _pairs(s)

    try:
        value = strict(text)
    except ValueError:
        return False, None
    if isinstance(value, str) and not isinstance(value, Number):
        try:
            inner = strict(value)
        except ValueError:
            return True, value
        if isinstance(inner, (dict, list)):
            return True, inner
    return True, value


def label(value, items: bool = True):
    """[pre, post, depth, level, kind, element, step, text, item] for each node below and including the root.

    pre and post number the nodes as a depth-first walk enters and leaves them; level counts the enclosing array
    elements, the node included if it is one; step is the node's key or position in its parent; text is a scalar's value;
    item is the path from the root if `items`, else empty, so that deep nesting costs no long paths.
    """
    pre = post = 0
    out = []
    stack = [(value, "", 0, 0, False, "", None)]
    while stack:
        node, item, depth, level, element, step, slot = stack.pop()
        if slot is not None:  # leaving
            out[slot][1] = post
            post += 1
            continue
        level += element
        text, below = None, ()
        if isinstance(node, dict):
            kind = "object"
            below = [(v, f"{item}/{k}" if items else "", depth + 1, level, False, k, None) for k, v in node.items()]
        elif isinstance(node, list):
            kind = "array"
            below = [(v, f"{item}/{k}" if items else "", depth + 1, level, True, str(k), None) for k, v in enumerate(node)]
        elif node is None:
            kind = "null"
        elif isinstance(node, bool):
            kind, text = "boolean", "true" if node else "false"
        else:
            kind, text = "number" if isinstance(node, Number) else "string", str(node)
        out.append([pre, post, depth, level, kind, element, step, text, item])
        pre += 1
        if below:
            stack.append((None, "", depth, level, False, "", len(out) - 1))
            stack.extend(reversed(below))
        else:
            post += 1
    return out
