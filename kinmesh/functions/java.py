"""A small reader of Java sources: names of syntax nodes in a tree, for structural features.

It covers the constructs whose nodes are counted. What it cannot read becomes a node ERROR
that spans up to the next statement or member, and reading goes on behind it.
"""

from __future__ import annotations

import re

#: Lexical classes of Java, and node names of its grammar.
LEX = re.compile(
    r'"""(?:[^\\]|\\.)*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|0[xX][0-9a-fA-F_]+[lL]?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdD]?'
    r"|\d[\d_]*\.(?!\.)(?:[eE][+-]?\d+)?[fFdD]?|\d[\d_]*(?:[eE][+-]?\d+[fFdD]?|[fFdD])|\d[\d_]*[lL]?|[^\W\d][\w$]*|\$[\w$]*"
    r"|>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/%&|^]=|\S",
    re.DOTALL,
)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "transient", "volatile", "default", "sealed"}
PRIMITIVES = {"int": "integral_type", "long": "integral_type", "short": "integral_type", "byte": "integral_type", "char": "integral_type", "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
JUMPS = {"return": "return_statement", "throw": "throw_statement", "break": "break_statement", "continue": "continue_statement", "yield": "yield_statement"}
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
CONSTANTS = {"true": "true", "false": "false", "null": "null_literal", "this": "this", "super": "super"}
RESERVED = {"if", "else", "for", "while", "do", "switch", "case", "try", "catch", "finally", "class", "interface", "enum", "new", "instanceof", "import", "package", *JUMPS} - {"yield"}


class Unreadable(Exception):
    pass


class Reader:
    def __init__(self, source: str):
        self.t, self.k, self.errors, self.depth = LEX.findall(source), 0, 0, 0

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.k + ahead] if self.k + ahead < len(self.t) else ""

    def take(self, *wanted: str) -> str:
        """The next token, which must be one of ``wanted`` if there are any."""
        token = self.peek()
        if not token or wanted and token not in wanted:
            raise Unreadable
        self.k += 1
        return token

    def skip(self, token: str) -> bool:
        if self.peek() == token:
            self.k += 1
            return True
        return False

    def name(self) -> tuple:
        if not re.match(r"[^\W\d]|\$", self.peek()) or self.peek() in RESERVED:
            raise Unreadable
        self.k += 1
        return ("identifier", [])

    def attempt(self, read):
        """What ``read`` returns, or None and no token taken."""
        at, errors = self.k, self.errors
        try:
            return read()
        except Unreadable:
            self.k, self.errors = at, errors
            return None

    def listed(self, read, end: str) -> list:
        """Comma-separated items up to ``end``, which is taken."""
        out = []
        while not self.skip(end):
            out.append(read())
            if not self.skip(","):
                self.take(end)
                break
        return out

    def guarded(self, read) -> tuple:
        """An item of a body, or ERROR up to where the next one may begin."""
        at = self.k
        try:
            return read()
        except (Unreadable, RecursionError):
            self.k, level = at, 0
            while self.peek():
                token = self.take()
                level += (token == "{") - (token == "}")
                if level < 0:
                    self.k -= 1
                    break
                if level == 0 and token in ";}":
                    break
            self.k += self.k == at
            self.errors += 1
            return ("ERROR", [])

    def body(self, kind: str, read) -> tuple:
        self.take("{")
        out = []
        while self.peek() not in ("}", ""):
            if not self.skip(";"):
                out.append(self.guarded(read))
        if not self.skip("}"):
            self.errors += 1
        return (kind, out)

    # --- declarations

    def program(self) -> tuple:
        out = []
        while self.peek():
            if not self.skip(";"):
                out.append(self.guarded(self.top))
        return ("program", out)

    def top(self) -> tuple:
        if self.peek() in ("package", "import"):
            kind = self.take()
            self.skip("static")
            name = self.dotted("identifier", "scoped_identifier")
            tail = [("asterisk", [])] if self.skip(".") and self.take("*") else []
            self.take(";")
            return (f"{kind}_declaration", [name, *tail])
        return self.member()

    def dotted(self, one: str, many: str) -> tuple:
        self.name()
        node = (one, [])
        while self.peek() == "." and re.match(r"[^\W\d]", self.peek(1)) and self.peek(1) not in RESERVED:
            self.k += 2
            node = (many, [node, (one, [])])
        return node

    def modifiers(self) -> list:
        notes, any_word = [], False
        while self.peek() in MODIFIERS or self.peek() == "@" and self.peek(1) != "interface":
            any_word = True
            if self.take() == "@":
                self.dotted("identifier", "scoped_identifier")
                if self.skip("("):
                    notes.append(("annotation", [("identifier", []), ("annotation_argument_list", self.listed(self.expression, ")"))]))
                else:
                    notes.append(("marker_annotation", [("identifier", [])]))
        return [("modifiers", notes)] if any_word else []

    def type(self) -> tuple:
        if self.peek() in PRIMITIVES:
            node = (PRIMITIVES[self.take()], [])
        else:
            node = self.dotted("type_identifier", "scoped_type_identifier")
            if self.peek() == "<":
                node = ("generic_type", [node, self.type_arguments()])
                while self.peek() == "." and self.peek(1) not in ("class", "this", "new", "super"):
                    self.k += 1
                    self.name()
                    node = ("scoped_type_identifier", [node, ("type_identifier", [])])
        return self.array_of(node)

    def array_of(self, node: tuple) -> tuple:
        if self.peek() == "[" and self.peek(1) == "]":
            while self.peek() == "[" and self.peek(1) == "]":
                self.k += 2
            return ("array_type", [node, ("dimensions", [])])
        return node

    def type_arguments(self) -> tuple:
        def one() -> tuple:
            if self.skip("?"):
                return ("wildcard", [self.type()] if self.skip("extends") or self.skip("super") else [])
            return self.type()

        self.take("<")
        return ("type_arguments", self.listed(one, ">"))

    def type_parameters(self) -> list:
        def one() -> tuple:
            self.name()
            bound = []
            if self.skip("extends"):
                bound = [self.type()]
                while self.skip("&"):
                    bound.append(self.type())
            return ("type_parameter", [("type_identifier", []), *([("type_bound", bound)] if bound else [])])

        return [("type_parameters", self.listed(one, ">"))] if self.skip("<") else []

    def types(self) -> list:
        out = [self.type()]
        while self.skip(","):
            out.append(self.type())
        return out

    def member(self) -> tuple:
        if self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
            own = self.skip("static")
            block = self.block()
            return ("static_initializer", [block]) if own else block
        head = self.modifiers()
        if self.skip("@"):
            self.take("interface")
            return ("annotation_type_declaration", [*head, self.name(), self.body("annotation_type_body", self.member)])
        word = self.peek()
        if word in TYPE_WORDS and (word != "record" or self.peek(2) in ("(", "<")):
            return self.type_declaration(head)
        head += self.type_parameters()
        if self.peek(1) == "(" and self.peek() not in PRIMITIVES:
            self.name()
            return ("constructor_declaration", [*head, ("identifier", []), self.parameters(), *self.throws(), ("constructor_body", self.block()[1])])
        kind = self.type()
        if self.peek(1) == "(":
            self.name()
            node = [*head, kind, ("identifier", []), self.parameters(), *self.throws()]
            if self.skip("default"):
                node.append(self.expression())
            return ("method_declaration", [*node, *([] if self.skip(";") else [self.block()])])
        node = ("field_declaration", [*head, kind, *self.declarators()])
        self.take(";")
        return node

    def type_declaration(self, head: list) -> tuple:
        word = self.take()
        node = [*head, self.name(), *self.type_parameters()]
        if word == "record":
            node.append(self.parameters())
        if self.skip("extends"):
            node.append(("superclass", [self.type()]) if word == "class" else ("extends_interfaces", [("type_list", self.types())]))
        for clause, kind in (("implements", "super_interfaces"), ("permits", "permits")):
            if self.skip(clause):
                node.append((kind, [("type_list", self.types())]))
        if word == "enum":
            return ("enum_declaration", [*node, self.enum_body()])
        return (f"{word}_declaration", [*node, self.body("interface_body" if word == "interface" else "class_body", self.member)])

    def enum_body(self) -> tuple:
        self.take("{")
        out = []
        while self.peek() not in (";", "}", ""):
            node = [*self.modifiers(), self.name()]
            if self.skip("("):
                node.append(("argument_list", self.listed(self.expression, ")")))
            if self.peek() == "{":
                node.append(self.body("class_body", self.member))
            out.append(("enum_constant", node))
            if not self.skip(","):
                break
        if self.skip(";"):
            rest = []
            while self.peek() not in ("}", ""):
                if not self.skip(";"):
                    rest.append(self.guarded(self.member))
            out.append(("enum_body_declarations", rest))
        self.take("}")
        return ("enum_body", out)

    def parameters(self) -> tuple:
        def one() -> tuple:
            head = [*self.modifiers(), self.type()]
            if self.skip("..."):
                return ("spread_parameter", [*head, ("variable_declarator", [self.name()])])
            if self.skip("this"):
                return ("receiver_parameter", [*head, ("this", [])])
            name = self.name()
            dims = self.array_of(name)[1][1:]
            return ("formal_parameter", [*head, name, *dims])

        self.take("(")
        return ("formal_parameters", self.listed(one, ")"))

    def throws(self) -> list:
        return [("throws", self.types())] if self.skip("throws") else []

    def declarators(self) -> list:
        def one() -> tuple:
            name = self.name()
            node = [name, *self.array_of(name)[1][1:]]
            if self.skip("="):
                node.append(self.initial())
            return ("variable_declarator", node)

        out = [one()]
        while self.skip(","):
            out.append(one())
        return out

    def initial(self) -> tuple:
        return ("array_initializer", self.listed(self.initial, "}")) if self.skip("{") else self.expression()

    # --- statements

    def block(self) -> tuple:
        return self.body("block", self.statement)

    def condition(self) -> tuple:
        self.take("(")
        node = ("parenthesized_expression", [self.expression()])
        self.take(")")
        return node

    def local(self) -> tuple:
        head = [*self.modifiers(), self.type()]
        return ("local_variable_declaration", [*head, *self.declarators()])

    def statement(self) -> tuple:
        word = self.peek()
        if word == "{":
            return self.block()
        if word in ("if", "while", "do", "for", "try", "switch"):
            return getattr(self, "read_" + word)()
        if word in JUMPS and not (word == "yield" and self.peek(1) in ("=", ".", "(")):
            self.k += 1
            node = (JUMPS[word], [] if self.peek() == ";" else [self.expression()])
            self.take(";")
            return node
        if word == "assert":
            self.k += 1
            node = [self.expression()]
            if self.skip(":"):
                node.append(self.expression())
            self.take(";")
            return ("assert_statement", node)
        if word == "synchronized" and self.peek(1) == "(":
            self.k += 1
            return ("synchronized_statement", [self.condition(), self.block()])
        if self.peek(1) == ":" and re.match(r"[^\W\d]", word) and word not in ("default", "case"):
            self.k += 2
            return ("labeled_statement", [("identifier", []), self.statement()])

        def declared() -> tuple:
            node = self.local()
            self.take(";")
            return node

        if word in TYPE_WORDS and re.match(r"[^\W\d]", self.peek(1)) or word in ("abstract", "final", "static", "@") and (found := self.attempt(self.nested)):
            return self.nested() if word in TYPE_WORDS else found
        if (found := self.attempt(declared)) is not None:
            return found
        node = ("expression_statement", [self.expression()])
        self.take(";")
        return node

    def nested(self) -> tuple:
        head = self.modifiers()
        if self.peek() not in TYPE_WORDS:
            raise Unreadable
        return self.type_declaration(head)

    def one_statement(self) -> list:
        return [] if self.skip(";") else [self.guarded(self.statement)]

    def read_if(self) -> tuple:
        self.take("if")
        node = [self.condition(), *self.one_statement()]
        return ("if_statement", [*node, *(self.one_statement() if self.skip("else") else [])])

    def read_while(self) -> tuple:
        self.take("while")
        return ("while_statement", [self.condition(), *self.one_statement()])

    def read_do(self) -> tuple:
        self.take("do")
        node = self.one_statement()
        self.take("while")
        node.append(self.condition())
        self.take(";")
        return ("do_statement", node)

    def read_for(self) -> tuple:
        self.take("for")
        self.take("(")

        def each() -> list:
            head = [*self.modifiers(), self.type(), self.name()]
            self.take(":")
            return [*head, self.expression()]

        if (head := self.attempt(each)) is not None:
            self.take(")")
            return ("enhanced_for_statement", [*head, *self.one_statement()])
        node = []
        if not self.skip(";"):
            first = self.attempt(self.local)
            node += [first] if first else self.several(";")
            self.take(";")
        if not self.skip(";"):
            node.append(self.expression())
            self.take(";")
        node += [] if self.peek() == ")" else self.several(")")
        self.take(")")
        return ("for_statement", [*node, *self.one_statement()])

    def several(self, end: str) -> list:
        out = [self.expression()]
        while self.peek() != end:
            self.take(",")
            out.append(self.expression())
        return out

    def read_try(self) -> tuple:
        self.take("try")
        node, kind = [], "try_statement"
        if self.skip("("):
            kind, held = "try_with_resources_statement", []
            while not self.skip(")"):
                held.append(("resource", (self.attempt(self.local) or ("", [self.expression()]))[1]))
                self.skip(";")
            node.append(("resource_specification", held))
        node.append(self.block())
        while self.skip("catch"):
            self.take("(")
            head, kinds = self.modifiers(), [self.type()]
            while self.skip("|"):
                kinds.append(self.type())
            own = ("catch_formal_parameter", [*head, ("catch_type", kinds), self.name()])
            self.take(")")
            node.append(("catch_clause", [own, self.block()]))
        if self.skip("finally"):
            node.append(("finally_clause", [self.block()]))
        return (kind, node)

    def read_switch(self) -> tuple:
        self.take("switch")
        node = [self.condition()]
        self.take("{")
        groups: list = []
        while not self.skip("}"):
            if self.peek() in ("case", "default"):
                label = ("switch_label", [])
                if self.take() == "case":
                    label[1].append(self.ternary())
                    while self.skip(","):
                        label[1].append(self.ternary())
                if self.take(":", "->") == "->":
                    groups.append(("switch_rule", [label, self.guarded(self.statement)]))
                else:
                    groups.append(("switch_block_statement_group", [label]))
            elif not groups:
                raise Unreadable
            elif not self.skip(";"):
                groups[-1][1].append(self.guarded(self.statement))
        return ("switch_expression", [*node, ("switch_block", groups)])

    # --- expressions

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > 60:
            self.depth = 0
            raise Unreadable
        if (found := self.attempt(self.arrow)) is not None:
            self.depth -= 1
            return found
        left = self.ternary()
        if self.peek() in ASSIGN:
            self.k += 1
            left = ("assignment_expression", [left, self.initial()])
        self.depth = max(0, self.depth - 1)
        return left

    def arrow(self) -> tuple:
        if self.peek(1) == "->":
            head = self.name()
        elif self.peek() == "(" and self.peek(1) in (")", "final", "@") or self.peek() == "(" and re.match(r"[^\W\d]", self.peek(1)):
            plain = self.attempt(lambda: (self.take("("), ("inferred_parameters", self.listed(self.name, ")")))[1])
            head = plain if plain and self.peek() == "->" else None
            if plain and head is None:
                raise Unreadable
            head = head or self.parameters()
        else:
            raise Unreadable
        self.take("->")
        return ("lambda_expression", [head, self.block() if self.peek() == "{" else self.expression()])

    def ternary(self) -> tuple:
        test = self.binary(0)
        if not self.skip("?"):
            return test
        yes = self.expression()
        self.take(":")
        return ("ternary_expression", [test, yes, self.expression()])

    def binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            op = self.peek()
            size = 1
            if op == ">" and self.peek(1) == ">":  # shifts come as single marks, as they may close type arguments
                size = 3 if self.peek(2) == ">" else 2
                op = ">" * size
            elif op == "<" and self.peek(1) == "<":
                op, size = "<<", 2
            if op not in LEVELS[level]:
                return left
            self.k += size
            if op == "instanceof":
                self.skip("final")
                left = ("instanceof_expression", [left, self.type(), *([self.name()] if re.match(r"[^\W\d]", self.peek()) else [])])
            else:
                left = ("binary_expression", [left, self.binary(level + 1)])

    def unary(self) -> tuple:
        op = self.peek()
        if op in ("++", "--"):
            self.k += 1
            return ("update_expression", [self.unary()])
        if op in ("+", "-", "!", "~"):
            self.k += 1
            return ("unary_expression", [self.unary()])
        if op == "(" and (found := self.attempt(self.cast)) is not None:
            return found
        node = self.primary()
        while self.peek() in ("++", "--"):
            self.k += 1
            node = ("update_expression", [node])
        return node

    def cast(self) -> tuple:
        self.take("(")
        simple = self.peek() in PRIMITIVES
        kind = self.type()
        self.take(")")
        if not simple and not re.match(r"""[\w"'(!~$]""", self.peek()) or self.peek() == "instanceof":
            raise Unreadable
        return ("cast_expression", [kind, self.unary()])

    def arguments(self) -> tuple:
        self.take("(")
        return ("argument_list", self.listed(self.expression, ")"))

    def primary(self) -> tuple:
        token = self.peek()
        if token == "(":
            node = self.condition()
        elif token == "new":
            node = self.creation()
        elif token == "switch":
            node = self.read_switch()
        elif token[:1] == '"':
            self.k += 1
            node = ("string_literal", [])
        elif token[:1] == "'" and len(token) > 2:
            self.k += 1
            node = ("character_literal", [])
        elif token[:1].isdigit() or token[:1] == "." and token[1:2].isdigit():
            self.k += 1
            whole = re.fullmatch(r"[\d_]+[lL]?", token)
            node = ("hex_integer_literal" if token[:2].lower() == "0x" else "decimal_integer_literal" if whole else "decimal_floating_point_literal", [])
        elif token in CONSTANTS:
            self.k += 1
            node = (CONSTANTS[token], [])
            if self.peek() == "(" and token in ("this", "super"):
                node = ("explicit_constructor_invocation", [node, self.arguments()])
        elif token in PRIMITIVES:
            node = self.type()
        else:
            node = self.name()
            if self.peek() == "(":
                node = ("method_invocation", [node, self.arguments()])
        return self.trailers(node)

    def trailers(self, node: tuple) -> tuple:
        while True:
            if self.peek() == "." and self.peek(1) == "class":
                self.k += 2
                node = ("class_literal", [node])
            elif self.skip("."):
                if self.peek() == "new":
                    node = ("object_creation_expression", [node, *self.creation()[1]])
                    continue
                more = [self.type_arguments()] if self.peek() == "<" else []
                own = (CONSTANTS[self.take()], []) if self.peek() in ("this", "super") else self.name()
                node = ("method_invocation", [node, *more, own, self.arguments()]) if self.peek() == "(" else ("field_access", [node, own])
            elif self.peek() == "[" and self.peek(1) != "]":
                self.k += 1
                node = ("array_access", [node, self.expression()])
                self.take("]")
            elif self.peek() == "[" and self.peek(2) in ("::", ".", "["):
                node = self.array_of(node)
            elif self.skip("::"):
                node = ("method_reference", [node, *([] if self.skip("new") else [self.name()])])
            else:
                return node

    def creation(self) -> tuple:
        self.take("new")
        if self.peek() in PRIMITIVES:
            kind = (PRIMITIVES[self.take()], [])
        else:
            kind = self.dotted("type_identifier", "scoped_type_identifier")
            if self.peek() == "<":
                kind = ("generic_type", [kind, self.type_arguments()])
        if self.peek() == "[":
            node = [kind]
            while self.skip("["):
                if self.skip("]"):
                    node.append(("dimensions", []))
                else:
                    node.append(("dimensions_expr", [self.expression()]))
                    self.take("]")
            if self.peek() == "{":
                node.append(self.initial())
            return ("array_creation_expression", node)
        node = [kind, self.arguments()]
        if self.peek() == "{":
            node.append(self.body("class_body", self.member))
        return ("object_creation_expression", node)


def syntax_rows(source: str) -> list[tuple[int, str, int, list[str], list[int]]]:
    """(node, type, children, above, within) of each node from the root on, in order of the text.

    ``above`` are the types of its ancestors from the root down, ``within`` the numbers of the
    methods and constructors in whose bodies it lies. ``source`` is without comments. Nodes
    ERROR stand for what was not read.
    """
    reader = Reader(source)
    root = reader.program()
    rows, stack = [], [(root, [], [], None)]
    while stack:
        (kind, children), above, within, method = stack.pop()
        me = len(rows)
        rows.append((me, kind, len(children), above, within))
        below = [*above, kind]
        if method is not None and kind in ("block", "constructor_body"):
            within = [*within, method]
        own = me if kind in ("method_declaration", "constructor_declaration") else None
        stack += [(c, below, within, own) for c in reversed(children)]
    return rows
