"""Classes of mnemonics, immediates and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in the order in which they are tried: whole mnemonics, or prefixes of them.
MNEMONICS = [
    ("CALL", "whole", ("call", "bl", "blr", "jal", "jalr", "bal")),
    ("RET", "whole", ("ret", "retn", "eret", "bx", "jr")),
    ("SYSCALL", "whole", ("syscall", "svc", "swi", "int")),
    ("MOVE", "whole", ("mov", "move", "movz", "movn", "lea", "li", "la", "adr", "adrp", "csel")),
    ("LOAD", "prefix", ("ldr", "ld", "lw", "lh", "lb", "lbu", "lhu", "ldu", "movsx", "movzx")),
    ("STORE", "prefix", ("str", "st", "sw", "sh", "sb")),
    ("ARITH", "prefix", ("add", "sub", "mul", "imul", "div", "idiv", "madd", "msub", "neg", "inc", "dec")),
    ("LOGIC", "prefix", ("and", "orr", "or", "xor", "eor", "not", "bic", "nor")),
    ("SHIFT", "prefix", ("shl", "shr", "sar", "sal", "sll", "srl", "sra", "lsl", "lsr", "asr", "ror", "rol")),
    ("CMP", "prefix", ("cmp", "cmn", "test", "tst", "slt", "slti")),
    ("BRANCH_UNCOND", "whole", ("jmp", "j", "b", "br", "bra")),
    ("BRANCH_COND", "prefix", ("je", "jne", "jz", "jnz", "ja", "jae", "jb", "jbe", "jg", "jge", "jl", "jle", "jo", "jno", "js", "jns", "jp", "jnp", "beq", "bne", "bgt", "bge", "blt", "ble", "bhi", "bls", "bcs", "bcc", "cbz", "cbnz", "tbz", "tbnz")),
    ("STACK", "prefix", ("push", "pop")),
    ("STACK", "whole", ("enter", "leave", "stp", "ldp")),
]
# Classes of operations and types of edges, in the order of a record's counters.
OP_CLASSES = ("LOAD", "STORE", "ARITH", "LOGIC", "SHIFT", "CMP", "CALL", "RET", "BRANCH_COND", "BRANCH_UNCOND", "STACK", "MOVE", "SYSCALL", "OTHER")
EDGE_TYPES = (
    "CONDITIONAL_JUMP", "CONDITIONAL_CALL", "UNCONDITIONAL_JUMP", "UNCONDITIONAL_CALL", "FALL_THROUGH", "COMPUTED_JUMP",
    "COMPUTED_CALL", "INDIRECTION", "CALL_TERMINATOR", "TERMINATOR", "CONDITIONAL_TERMINATOR",
)
# Registers of the stack, and words of messages.
STACK_REGISTERS = ("sp", "rsp", "esp", "rbp", "ebp", "$sp", "r11", "fp", "x29")
MESSAGE_WORDS = ("error", "failed", "invalid", "usage")


def mnemonic_class(mnemonic: Column) -> Column:
    m = F.substring_index(F.lower(F.trim(mnemonic)), ".", 1)
    out = F.when(F.trim(mnemonic) == "", "OTHER")
    for name, kind, listed in MNEMONICS:
        out = out.when(m.isin(*listed) if kind == "whole" else m.rlike(f"^({'|'.join(listed)})"), name)
    return out.otherwise("OTHER")


def token_class(token: Column) -> Column:
    first = F.substring_index(F.trim(token), " ", 1)
    return F.when(first == "", "OTHER").otherwise(first)


def immediate_bucket(value: Column) -> Column:
    v = value.cast("long")
    return F.when(v.isNull(), "IMM").when(v == 0, "IMM_ZERO").when(v == 1, "IMM_ONE").when(v < 0, "IMM_NEG").when(v <= 0xFF, "IMM_SMALL").when(v <= 0xFFFF, "IMM_MEDIUM").when(v.bitwiseAND(v - 1) == 0, "IMM_MASK").otherwise("IMM_LARGE")


def string_category(value: Column) -> Column:
    s = F.coalesce(value, F.lit(""))
    low = F.lower(s)
    n = F.length(s)
    kind = F.when(low.rlike("^[0-9]+$"), "numeric").when(low.contains("://") | low.startswith("www."), "url_like").when(low.contains("/") | low.contains("\\"), "path_like")
    kind = kind.when(low.startswith("-"), "option_like").when(low.contains("%"), "format_like").when(low.rlike("|".join(MESSAGE_WORDS)), "message_like").otherwise("other")
    return F.concat(kind, F.lit(":"), F.when(n <= 8, "len_0_8").when(n <= 32, "len_9_32").when(n <= 128, "len_33_128").otherwise("len_129_plus"))


def operand_role(text: Column, kind: Column, value: Column) -> Column:
    """Role of an operand from its text, the kind of its object (reg, scalar, address or null) and its number."""
    low = F.lower(F.coalesce(text, F.lit("")))
    memory = (low.contains("[") & low.contains("]")) | (low.contains("(") & low.contains(")"))
    stack = F.lit(False)
    for r in STACK_REGISTERS:
        stack = stack | low.contains(r)
    return F.when(memory & stack, "MEM_STACK").when(memory, "MEM").when(kind == "address", "ADDR").when(kind == "reg", "REG").when(kind == "scalar", immediate_bucket(value)).when(low != "", "OPERAND").otherwise("NONE")


def instruction_token(mnemonic: Column, roles: Column) -> Column:
    return F.concat_ws(" ", mnemonic_class(mnemonic), F.array_join(F.filter(roles, lambda r: r != "NONE"), " ")) if roles is not None else mnemonic_class(mnemonic)
