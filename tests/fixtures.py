"""A small library desk walkthrough, in two sessions, made up for these tests."""

from tracewright import schema

SCREENS = [
    ("S01", "Member search", "Find a member by name", [0], 0.0, ["F001", "F002"], ["A001"]),
    ("S02", "Loan desk", "Lend and return books", [2, 1], 30.0, ["F003"], ["A002"]),
    ("S03", "Fines", "See what is owed", [], 60.0, [], []),
    ("S04", "Archive", "Old members", [4], 80.0, [], []),
]
FIELDS = [
    ("F001", "S01", "Member name", "text", True, "Ada", "shown", 1.0, 0, None),
    ("F002", "S01", "Card number", "text", None, None, "shown", 2.0, 0, None),
    ("F003", "S02", "Loan status", "dropdown", False, "On loan", "spoken", 31.0, 1, None),
    ("F004", "S09", "Shelf mark", "text", False, None, "shown", 32.0, 1, None),
    ("F005", "S03", "member name", "text", False, None, "shown", 61.0, 3, None),
]
ACTIONS = [
    ("A001", "S01", "Presses Search", "button", "S02", 3.0, 0),
    ("A002", "S02", 'Clicks the "Return" button', "button", None, 33.0, 1),
    ("A003", "S02", "Scans the barcode", None, None, 34.0, 1),
    ("A004", "S02", "Opens Fines", "menu", "S03", 35.0, 2),
    ("A005", "S01", "Presses Search", None, "S02", 36.0, 2),
]
JOURNEY = [(1, "S01", "Looks up the member", "Librarian", 1.0, 0), (2, "S02", "Lends the book", " librarian ", 31.0, 1), (3, "S01", "Goes back", None, 50.0, 2), (4, "S03", "Looks at fines", "Manager", 61.0, 3)]
REQUIREMENTS = [
    ("R1", "As a librarian, I want to search by member name so that it is quick", None, "we look them up", 5.0, 0, "S01", "functional", "must", "high"),
    ("R2", "The system must show the loan statuses and send reminders where possible", "Members forget", "", 35.0, 1, None, "workflow", "should", "low"),
    ("R10", "Fines are calculated every day", None, "each night", 65.0, 3, None, "functional", "could", "medium"),
]
CRITERIA = [("AC1", "R1", "a member exists", "the name is typed", "it works", 6.0, 0), ("AC2", "R2", "a book is lent", "", "the status shows On loan or Late", 36.0, 1), ("AC3", "R77", "x", "y", "z", 1.0, -1)]
QUESTIONS = [
    ("Q1", "Who may waive a fine?", "money", None, 66.0, 3, "S03", "rules", ["R10", "R2"], None, "open"),
    ("Q2", "Is the card number checked?", "data", "hm", 7.0, 0, None, "data", ["R1", "R99"], "Yes, by checksum", "answered"),
]
ACTORS = ["Librarian", "Borrower"]


def analysis(spark, run="a"):
    row = (run, "Library desk", "Lending", ACTORS, SCREENS, FIELDS, ACTIONS, JOURNEY, REQUIREMENTS, CRITERIA, QUESTIONS, ("m", 2, 10, 5, 1, 0))
    return spark.createDataFrame([row], schema.ANALYSIS)


def tables(spark, run="a"):
    return schema.entities(analysis(spark, run))
