"""Prompt templates as data (U2): each template is a list of parts joined by
newlines; a part is either fixed text or the name of an input column."""

from __future__ import annotations

# Prompt texts of the text-dataset styles, kept verbatim so the
# produced prompts equal the published ones (blank context lines of the
# example patch are a single space).
PREMISE = ("You will be provided with a partial code base and an issue statement "
           "explaining a problem to resolve.")
PATCH_INSTRUCTIONS = ("I need you to solve this issue by generating a single patch file that I can apply "
                      "directly to this repository using git apply. Please respond with a single patch "
                      "file in the following format.")
EXAMPLE_EXPLANATION = ("Here is an example of a patch file. It consists of changes to the code base. "
                       "It specifies the file names, the line numbers of each change, and the removed and "
                       "added lines. A single patch file can contain changes to multiple files.")
FINAL_INSTRUCTION = ("I need you to solve the provided issue by generating a single patch file that I can "
                     "apply directly to this repository using git apply. Please respond with a single patch "
                     "file in the format shown above.")
FULL_FILE_INSTRUCTIONS = ("I need you to solve this issue by regenerating the full files in the code base that "
                          "you would like to change. You can change as many files as you like. Please respond "
                          "with a list of files and their revised contents in the following format.")

PATCH_EXAMPLE = """--- a/file.py
+++ b/file.py
@@ -1,27 +1,35 @@
 def euclidean(a, b):
-    while b:
-        a, b = b, a % b
-    return a
+    if b == 0:
+        return a
+    return euclidean(b, a % b)
 
 
 def bresenham(x0, y0, x1, y1):
     points = []
     dx = abs(x1 - x0)
     dy = abs(y1 - y0)
-    sx = 1 if x0 < x1 else -1
-    sy = 1 if y0 < y1 else -1
-    err = dx - dy
+    x, y = x0, y0
+    sx = -1 if x0 > x1 else 1
+    sy = -1 if y0 > y1 else 1
 
-    while True:
-        points.append((x0, y0))
-        if x0 == x1 and y0 == y1:
-            break
-        e2 = 2 * err
-        if e2 > -dy:
+    if dx > dy:
+        err = dx / 2.0
+        while x != x1:
+            points.append((x, y))
             err -= dy
-            x0 += sx
-        if e2 < dx:
-            err += dx
-            y0 += sy
+            if err < 0:
+                y += sy
+                err += dx
+            x += sx
+    else:
+        err = dy / 2.0
+        while y != y1:
+            points.append((x, y))
+            err -= dx
+            if err < 0:
+                x += sx
+                err += dy
+            y += sy
 
+    points.append((x, y))
     return points"""

FULL_GENERATION_EXAMPLE = """[start of /src/this_file.py]
import os

def euclidean(a, b):
    if b == 0:
        return a
    return euclidean(b, a % b)
[end of /src/this_file.py]
[start of /src/another_file.py]
def bresenham(x0, y0, x1, y1):
    points = []
    dx = abs(x1 - x0)
    dy = abs(y1 - y0)
    x, y = x0, y0
    sx = -1 if x0 > x1 else 1
    sy = -1 if y0 > y1 else 1
    if dx > dy:
        err = dx / 2.0
        while x != x1:
            points.append((x, y))
            err -= dy
            if err < 0:
                y += sy
                err += dx
            x += sx
    else:
        err = dy / 2.0
        while y != y1:
            points.append((x
            err -= dx
            if err < 0:
                x += sx
                err += dy
            y += sy
    points.append((x, y))
    return points
[end of /src/another_file.py]"""

TEMPLATES = {
    "style-2": [PREMISE, "<issue>", ("col", "problem_statement"), "</issue>", "<code>",
                ("col", "readmes_text"), ("col", "code_text"), "</code>", PATCH_INSTRUCTIONS,
                "<patch>", PATCH_EXAMPLE, "</patch>"],
    "style-3": [PREMISE, "<issue>", ("col", "problem_statement"), "</issue>", "", "<code>",
                ("col", "readmes_text"), ("col", "code_text"), "</code>", "", EXAMPLE_EXPLANATION,
                "<patch>", PATCH_EXAMPLE, "</patch>", "", FINAL_INSTRUCTION, "Respond below:"],
    "full_file_gen": [PREMISE, "<issue>", ("col", "problem_statement"), "</issue>", "<code>",
                      ("col", "readmes_text"), ("col", "code_text"), "</code>", FULL_FILE_INSTRUCTIONS,
                      "<example>", FULL_GENERATION_EXAMPLE, "</example>"],
}
# the same parts; its code text is the edits-only excerpt
TEMPLATES["style-2-edits-only"] = TEMPLATES["style-2"]

# Prompts of the locate → edit repair chain ({name} marks an input column).
LOCATE_FILES_PROMPT = """### Repository Structure ###
{structure}

###

### GitHub Problem Description ###
{problem_statement}

###

Please look through the Repository structure and GitHub problem description and provide a list of files that one would need to edit to fix the problem.
Please only provide the full path and return the most important 20 files.
The returned files should be separated by new lines and wrapped with ```
For example:
```
django/db/models/fields/__init__.py
django/db/migrations/serializer.py
django/conf/__init__.py
sympy/core/mul.py
...
```

Do not miss ``` before and after the files.
"""

LOCATE_SYMBOLS_PROMPT = '''### Code Skeleton ###
{file_skeleton}

###

### Problem ###
{problem_statement}

###

Please provide a complete set of locations related to fixing the problem, including directly related ones as well as any potentially related functions, classes, methods and variables.
Please provide each location using one of the following formats and concatenate them with two blank lines.
```
Format 1
# file1.py
function: ...

Format 2
# file2.py
class: ...

Format 3
# file3.py
class: ...
method: ...

Format 4
# file4.py
variable: ...
```

Return the most important 30 locations.
Do not miss ``` before and after the locations.'''

REPAIR_PROMPT = '''### Code ###
{code_content}

###

### Problem ###
{problem_statement}

###

Generate the most important edit using the following format:
1. The file path
2. The start of search block: <<<<<<< SEARCH
3. A contiguous chunk of lines to search for in the existing source code
4. The dividing line: =======
5. The lines to replace into the source code
6. The end of the replace block: >>>>>>> REPLACE

For example:
```python
### xxx/xx.py
<<<<<<< SEARCH
original code
=======
code after modification
>>>>>>> REPLACE
```

Please note that the *SEARCH/REPLACE* edit REQUIRES PROPER INDENTATION. If you would like to add the line '        print(x)', you must fully write that out, with all those spaces before the code!
Don't forget import.
Wrap each *SEARCH/REPLACE* edit in blocks ```python...```.'''
