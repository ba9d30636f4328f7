"""Types of the engine's tables. A row is a sentence; its tokens are an array, and `head` is a place in it (a root is its own head)."""

from __future__ import annotations

import pyarrow as pa

SUB = "struct<surface:string,tag:string,inf:string,lemma:string,reading:string,norm:string>"
SUBS = f"struct<a:array<{SUB}>,b:array<{SUB}>>"
TOKEN = (
    "struct<orth:string,ws:string,lemma:string,norm:string,pos:string,tag:string,dep:string,head:int,"
    "ent_iob:string,ent_type:string,reading:string,inflection:string,idx:int>"
)
SENTENCE = f"doc_id bigint, sent_id int, text string, tokens array<{TOKEN}>"

#: What recognition adds to each token; places are in the sentence.
UNIT = (
    "struct<is_head:boolean,bi:string,position:string,bunsetu:int,bunsetu_root:int,label:string,phrase_start:int,phrase_end:int,"
    "clause:int,depth:int,root:int,left:int,right:int,descendants:int,start:int,end:int,link_offset:int,link_bunsetu:int,func_offset:int>"
)

STRINGS = ("orth", "ws", "lemma", "norm", "pos", "tag", "dep")
ARROW_TOKEN = pa.struct(
    [(n, pa.string()) for n in STRINGS]
    + [("head", pa.int32())]
    + [(n, pa.string()) for n in ("ent_iob", "ent_type", "reading", "inflection")]
    + [("idx", pa.int32())]
)
ARROW_UNIT = pa.struct(
    [
        ("is_head", pa.bool_()),
        ("bi", pa.string()),
        ("position", pa.string()),
        ("bunsetu", pa.int32()),
        ("bunsetu_root", pa.int32()),
        ("label", pa.string()),
        *[(n, pa.int32()) for n in ("phrase_start", "phrase_end", "clause", "depth", "root", "left", "right", "descendants", "start", "end", "link_offset", "link_bunsetu", "func_offset")],
    ]
)
