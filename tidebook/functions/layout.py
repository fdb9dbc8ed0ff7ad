"""The message registry of the venue's feed: one text table is the source for decoding, encoding,
wire sizes and schemas. Another venue is another ``Venue`` built from its own table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

# Per type its code, name, and after the common header the body fields in wire order.
# aN text of N bytes; uN unsigned big-endian of N bytes; pN price of N bytes (4: 4 decimals, 8: 8 decimals).
ORDER_FEED = """
S SystemEvent: event_code a1
R StockDirectory: stock a8, market_category a1, financial_status_indicator a1, round_lot_size u4, round_lots_only a1, issue_classification a1, issue_sub_type a2, authenticity a1, short_sale_threshold_indicator a1, ipo_flag a1, luld_ref a1, etp_flag a1, etp_leverage_factor u4, inverse_indicator a1
H StockTradingAction: stock a8, trading_state a1, reserved a1, reason a4
Y RegSHO: stock a8, reg_sho_action a1
L MarketParticipantPosition: mpid a4, stock a8, primary_market_maker a1, market_maker_mode a1, market_participant_state a1
V MWCBDeclineLevel: level1 p8, level2 p8, level3 p8
W MWCBStatus: breached_level a1
K IPOQuotingPeriodUpdate: stock a8, ipo_quotation_release_time u4, ipo_quotation_release_qualifier a1, ipo_price p4
J LULDAuctionCollar: stock a8, auction_collar_reference_price p4, upper_auction_collar_price p4, lower_auction_collar_price p4, auction_collar_extension u4
h OperationalHalt: stock a8, market_code a1, operational_halt_action a1
A AddOrder: order_reference_number u8, buy_sell_indicator a1, shares u4, stock a8, price p4
F AddOrderMPIDAttribution: order_reference_number u8, buy_sell_indicator a1, shares u4, stock a8, price p4, attribution a4
E OrderExecuted: order_reference_number u8, executed_shares u4, match_number u8
C OrderExecutedWithPrice: order_reference_number u8, executed_shares u4, match_number u8, printable a1, execution_price p4
X OrderCancel: order_reference_number u8, cancelled_shares u4
D OrderDelete: order_reference_number u8
U OrderReplace: original_order_reference_number u8, new_order_reference_number u8, shares u4, price p4
P NonCrossTrade: order_reference_number u8, buy_sell_indicator a1, shares u4, stock a8, price p4, match_number u8
Q CrossTrade: shares u8, stock a8, cross_price p4, match_number u8, cross_type a1
B BrokenTrade: match_number u8
I NOII: paired_shares u8, imbalance_shares u8, imbalance_direction a1, stock a8, far_price p4, near_price p4, current_reference_price p4, cross_type a1, price_variation_indicator a1
N RetailPriceImprovementIndicator: stock a8, interest_flag a1
O DLCR: stock a8, open_eligibility_status a1, min_allowable_price p4, max_allowable_price p4, near_execution_price p4, near_execution_time u8, lower_price_range_collar p4, upper_price_range_collar p4
"""
# The header of every body.
HEADER = "message_type a1, stock_locate u2, tracking_number u2, ts_ns u6"
# Which types add, modify and trade.
CATEGORIES = {"add": "AF", "modify": "ECXDU", "trade": "PQB"}
#: Order-book messages.
BOOK_TYPES = tuple("AFECXDU")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    size: int
    offset: int

    @property
    def decimals(self) -> int:
        return {4: 4, 8: 8}[self.size] if self.kind == "p" else 0


@dataclass(frozen=True)
class MessageType:
    code: str
    name: str
    fields: tuple[Field, ...]

    @property
    def wire_size(self) -> int:
        last = self.fields[-1]
        return last.offset + last.size

    @property
    def price_precision(self) -> int:
        """Decimals of every field that holds a price."""
        return max([f.decimals for f in self.fields]) or 4

    @property
    def category(self) -> str:
        return next((c for c, codes in CATEGORIES.items() if self.code in codes), "other")

    @property
    def body(self) -> tuple[Field, ...]:
        return self.fields[4:]


def _fields(text: str, at: int = 0) -> tuple[Field, ...]:
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, kind = part.split()
        out.append(Field(name, kind[0], int(kind[1:]), at))
        at += int(kind[1:])
    return tuple(out)


@dataclass(frozen=True)
class Venue:
    """A named registry of message types."""

    name: str
    table: str

    @cached_property
    def types(self) -> Mapping[str, MessageType]:
        head = _fields(HEADER)
        end = head[-1].offset + head[-1].size
        out = {}
        for line in self.table.strip().splitlines():
            left, _, right = line.partition(":")
            code, name = left.split()
            out[code] = MessageType(code, name, head + _fields(right, end))
        return out

    def size_of(self, code: str) -> int | None:
        t = self.types.get(code)
        return t.wire_size if t else None


DEFAULT = Venue("order_feed", ORDER_FEED)
