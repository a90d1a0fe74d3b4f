"""Small inputs for queries whose operators read source code, which the driver's tables do not hold."""

from __future__ import annotations

SYMBOLS = [("a.ts", 0, "A", "class", 1, 10), ("a.ts", 1, "m", "method", 3, 5), ("a.ts", 2, "f", "function", 12, 14), ("b.ts", 0, "g", "function", 2, 3), ("c.ts", 0, "big", "function", 7, 9)]
TEXTS = [("a.ts", "\n".join(f"line {i}" for i in range(1, 15))), ("b.ts", "top\ng {\n}\nend"), ("c.ts", "\n".join(["x"] * 6 + ["y" * 1500] * 3))]

SNIPPETS = [
    ("sql", "a.sql", "CREATE TABLE IF NOT EXISTS users (id int);\n-- c\ncreate view v as select 1;\nCREATE INDEX ix ON t(a);\nCREATE UNIQUE INDEX ux ON t(b);\nCREATE OR REPLACE FUNCTION f() AS 1;"),
    ("dockerfile", "Dockerfile", "# base\nFROM node:18\nENV A=1\nRUN x\nLABEL k=v"),
    ("config", "a.ini", "[s]\nk = v\n; c\n[t]\nx = 1"),
    ("csv", "a.csv", 'a,"b,c"\n1,2'),
    ("documentation", "a.rst", "Title\n=====\n\n.. note:: x\n.. code-block:: py"),
    ("text", "a.log", "2024-01-01 10:00:00 start\nok\nERROR bad\nat f (x.js:1)"),
    ("astro", "a.astro", "---\nimport A from './A.astro'\nconst x = 1\n---\n<A/>\n<style>\n</style>"),
    ("salesforce", "a.cls", "public with sharing class Foo {\n  private static void bar() {\n}\n}"),
    ("svg", "a.svg", '<svg>\n<g id="x" class="p q">\n</g>\n</svg>'),
    ("markdown", "a.md", "# One\ntext\n```js\nx\n```\nTwo\n---"),
    ("toml", "a.toml", "[a]\nk = 1\n[[b]]\nm = 2"),
    ("yaml", "a.yaml", "a:\n  b: 1\n  - c: 2"),
    ("json", "a.json", '{\n "a": {"b": 1},\n "c": [2]\n}'),
    ("xml", "a.xml", "<project>\n<name>x</name>\n</project>"),
    ("html", "a.html", "<html>\n<nav>\n</nav>\n<my-tag>\n</my-tag>\n</html>"),
    ("css", "a.css", ".a, .b {\n}\n#c {\n x: y;\n}"),
    ("py", "a.py", "import os\nclass A:\n    def f(self):\n        pass\ndef g():\n    pass"),
    ("ts", "a.ts", "import x from './x'\ninterface I {\n}\nclass A {\n  m(a: number) {\n  }\n}\nfunction f() {\n  return 1\n}\nenum E {\n}"),
    ("js", "a.js", "class A {\n}\nfunction f() {\n}\nconst g = (a) => {\n}"),
    ("go", "a.go", "import \"fmt\"\nfunc F() {\n}\nfunc (s *T) M() {\n}"),
    ("rs", "a.rs", "use std::io;\npub struct S {\n}\ntrait T {\n}\nimpl S {\n  fn f() {\n  }\n}\nenum E {\n}"),
    ("java", "A.java", "import a.b;\npublic class A {\n  public int f() {\n  }\n}"),
    ("rb", "a.rb", "require 'x'\nclass A\n  def f\n  end\nend"),
    ("c", "a.c", "#include <x.h>\nstruct S {\n};\nint f(int a) {\n}"),
    ("cpp", "a.cpp", "class A {\n};\nint f() {\n}"),
    ("csharp", "a.cs", "using System;\npublic class A {\n  public int F() {\n  }\n}"),
    ("php", "a.php", "<?php\nclass A {\n  public function f() {\n  }\n}\nfunction g() {\n}"),
    ("swift", "a.swift", "import X\nstruct S {\n  func f() {\n  }\n}"),
    ("kotlin", "a.kt", "package p\nimport q.r\nclass A {\n  fun f() {\n  }\n}"),
    ("dart", "a.dart", "import 'x.dart'\nclass A {\n}\nint f() {\n}"),
    ("scala", "a.scala", "package p\nobject O {\n  def f() = {\n  }\n  val x = 1\n}"),
    ("haskell", "a.hs", "module M where\nimport Data.List\ndata D = D\nf :: Int\nf = 1"),
    ("solidity", "a.sol", "contract C {\n  uint256 public x;\n  function f() public {\n  }\n  event E();\n}"),
    ("lua", "a.lua", "local m = require('x')\nlocal function f()\nend\nfunction M.g()\nend"),
    ("terraform", "a.tf", 'resource "a" "b" {\n  x = 1\n}'),
    ("vue", "a.vue", "<template>\n<MyTag/>\n</template>\n<script>\n</script>"),
    ("svelte", "a.svelte", "<script>\n</script>\n{#if x}\n<A/>\n{/if}"),
]
#: Symbols of the snippets, worked out by hand: (name, type, first line, last line).
EXPECTED = {
    "sql": [("users", "table", 1, 1), ("v", "table", 3, 3), ("ix", "property", 4, 4), ("ix", "property", 4, 4), ("ux", "property", 5, 5), ("f", "function", 6, 6)],
    "dockerfile": [("FROM", "import", 2, 2), ("ENV", "variable", 3, 3), ("RUN", "function", 4, 4), ("LABEL", "property", 5, 5)],
    "config": [("s", "section", 1, 1), ("k", "property", 2, 2), ("t", "section", 4, 4), ("x", "property", 5, 5)],
    "csv": [("headers", "module", 1, 1), ("a", "property", 1, 1), ("b,c", "property", 1, 1), ("data", "table", 2, 2)],
    "documentation": [("Title", "section", 1, 2), ("note", "function", 4, 4), ("code-block", "module", 5, 5)],
    "text": [("2024-01-01 10:00:00 start", "function", 1, 1), ("ERROR bad", "function", 3, 3), ("stackTrace", "function", 4, 4)],
    "astro": [("frontmatter", "section", 1, 4), ("A", "import", 2, 2), ("x", "variable", 3, 3), ("A", "class", 5, 5), ("style", "section", 6, 6)],
    "salesforce": [("Foo", "class", 1, 1), ("bar", "function", 2, 2)],
    "svg": [("svg", "module", 1, 1), ("g", "module", 2, 2), ("x", "property", 2, 2), ("p", "property", 2, 2), ("q", "property", 2, 2)],
    "markdown": [("One", "section", 1, 1), ("code_block_js", "module", 3, 5), ("Two", "section", 6, 7)],
    "toml": [("a", "section", 1, 1), ("k", "property", 2, 2), ("b", "section", 3, 3), ("m", "property", 4, 4)],
    "yaml": [("a", "property", 1, 1), ("b", "property", 2, 2), ("c", "property", 3, 3)],
    "json": [("a", "property", 2, 2), ("b", "property", 2, 2), ("c", "property", 3, 3)],
    "xml": [("project", "module", 1, 3), ("name", "property", 2, 2)],
    "html": [("nav", "module", 2, 3), ("my-tag", "module", 4, 5)],
    "css": [(".a", "module", 1, 2), ("#c", "module", 3, 5)],
    "py": [("os", "import", 1, 1), ("A", "class", 2, 4), ("f", "function", 3, 4), ("g", "function", 5, 6)],
    "go": [('import "fmt"', "import", 1, 1), ("F", "function", 2, 3), ("M", "method", 4, 5)],
    "rs": [("std::io", "import", 1, 1), ("S", "struct", 2, 3), ("T", "trait", 4, 5), ("S", "module", 6, 9), ("f", "function", 7, 8), ("E", "enum", 10, 11)],
    "java": [("a.b", "import", 1, 1), ("A", "class", 2, 5), ("f", "method", 3, 4)],
    "rb": [("x", "import", 1, 1), ("A", "class", 2, 5), ("f", "method", 3, 4)],
    "c": [("S", "struct", 2, 3), ("f", "function", 4, 5)],
    "cpp": [("A", "class", 1, 2), ("f", "function", 3, 4)],
    "csharp": [("System", "import", 1, 1), ("A", "class", 2, 5), ("F", "method", 3, 4)],
    "php": [("A", "class", 2, 5), ("f", "method", 3, 4), ("g", "function", 6, 7)],
    "js": [("A", "class", 1, 2), ("f", "function", 3, 4), ("g", "function", 5, 6)],
    "swift": [("X", "import", 1, 1), ("S", "struct", 2, 5), ("f", "function", 3, 4)],
    "kotlin": [("p", "package", 1, 1), ("q.r", "import", 2, 2), ("A", "class", 3, 6), ("f", "function", 4, 5)],
    "dart": [("x.dart", "import", 1, 1), ("A", "class", 2, 3), ("f", "function", 4, 5)],
    "scala": [("p", "package", 1, 1), ("O", "object", 2, 6), ("f", "function", 3, 4), ("x", "constant", 5, 5)],
    "haskell": [("M", "module", 1, 1), ("Data.List", "import", 2, 2), ("D", "struct", 3, 3), ("f", "function", 4, 4)],
    "solidity": [("C", "class", 1, 6), ("x", "variable", 2, 2), ("f", "function", 3, 4), ("E", "function", 5, 5)],
    "lua": [("x", "import", 1, 1), ("f", "function", 2, 3), ("g", "method", 4, 5)],
    "terraform": [("resource", "module", 1, 3), ("x", "property", 2, 2)],
    "vue": [("template", "section", 1, 1), ("MyTag", "class", 2, 2), ("script", "section", 4, 4)],
    "svelte": [("script", "section", 1, 1), ("if", "function", 3, 3), ("A", "class", 4, 4)],
    "ts": [("import x from './x'", "import", 1, 1), ("I", "interface", 2, 3), ("A", "class", 4, 7), ("m", "method", 5, 6), ("f", "function", 8, 10), ("E", "enum", 11, 12)],
}
