"""Small tables with known answers."""

#: Parts of a workshop: a repeated id, nulls, texts of several content types, one odd number, a repeated link.
PARTS = [
    (1, "A", "407", 31, 52, 40, "https://tools.example.org/a", "ann@mill.org"),
    (2, "B", "VX9", 14, 47, 65, "http://10.0.0.7/parts", "bo.b@yard.net"),
    (3, "A", "Q", 27, 60, -300, None, "cy@mill.org"),
    (4, "C", "88", 14, 49, 52, "ftp://store.example.net", None),
    (5, "B", "VX10", 40, 55, 40, "see https://x.org now", "not a mail"),
    (6, "A", "LMN", 22, 51, 58, "http://10.0.0.7/parts", "d_d@lab.net"),
    (6, "B", "LM2", 9, 58, 71, None, None),
    (9, "A", "Z7", 35, 44, 47, "no link", "eve@mill.org"),
]
PARTS_SCHEMA = "id long, grade string, label string, stock long, width int, delta int, link string, mail string"

#: Deliveries for dependencies: depot and lane decide the gate, the gate decides the crew; both with exceptions and a null.
DELIVERIES = [
    (1, "north", 10, "G1", "red", "L"), (2, "north", 10, "G1", "red", "M"), (3, "north", 10, "G2", "blue", "L"), (4, "north", 20, "G3", "blue", None),
    (5, "north", 20, "G3", "green", "L"), (6, "south", 10, "G4", "red", "M"), (7, "south", 10, None, "red", "M"), (8, "south", 30, "G5", "blue", "S"),
    (9, "south", 30, "G5", "blue", "S"), (10, "east", 10, "G6", None, "L"),
]
DELIVERIES_SCHEMA = "id long, depot string, lane int, gate string, crew string, size string"

#: Two dense groups and one point far from both.
POINTS = [(i, 100 + i % 3, 40 + i % 2) for i in range(7)] + [(7, -90, 41)] + [(8 + i, 15 + i % 2, 6 + i % 3) for i in range(6)]
