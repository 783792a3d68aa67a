"""Labelled rows on which the classifier of templates is fitted; what is prose it learns from the corpus."""

from __future__ import annotations

# Labelled rows for the classifier, messages of failing, refusing or script-dependent pages.
MESSAGE = """
404 Not Found
The page you requested could not be found on this server.
The selected record could not be located on this portal.
Sorry, this page does not exist or has been moved.
403 Forbidden
Access denied
You don't have permission to access this page on this server. Ref 18
You are not allowed to open this file.
401 Unauthorized. Please log in to continue.
500 Internal Server Error
HTTP 503 Service Unavailable
502 Bad Gateway
504 Gateway Time-out
Service temporarily unavailable. Please retry in 30 seconds.
The site is temporarily offline. Try again later.
Too many requests. Your address was blocked for 10 minutes.
Too many attempts, please wait and retry.
Your session has expired. Please sign in again.
This link has expired.
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
This site relies on scripts. Turn them on and reload.
JavaScript is disabled in your browser. Some features will not work.
Your browser does not support scripts or cookies.
Checking your browser before accessing the site...
Verifying your browser before opening the page...
Please turn on scripting to read this page.
Please enable scripting.
Please verify that you are human by completing the captcha.
Error 1045
An unexpected error occurred. Contact the administrator.
Fatal error: Uncaught exception in index.php on line 12
Warning: Undefined variable $item in view.php on line 40
Notice: Undefined index: page in detail.php on line 7
Warning: call to a member function load() on null in app.php on line 3
Traceback (most recent call last):
File "app.py", line 10, in main
KeyError: 'title'
TypeError: 'NoneType' object is not callable
java.lang.NullPointerException
at org.example.Page.open(Page.java:55)
at web.render.Loader.doGet.java:20
ORA-12541: no listener
SQLSTATE[HY000]: could not open the table
DB-17: connection to the database was lost
HTTP Status 500 - type Exception report
404 - Không tìm thấy trang
Không tìm thấy trang bạn yêu cầu. Vui lòng quay lại trang chủ.
Không tìm thấy tài liệu mã 12. Xin liên hệ quản trị.
Không tìm thấy văn bản này. Vui lòng thử từ khóa khác.
Trang này không còn tồn tại.
Bài này đã bị gỡ, mã 15.
Liên kết này đã chuyển sang địa chỉ khác.
Đường dẫn này không còn hiệu lực.
Bạn không có quyền truy cập trang này.
Tài khoản này không có quyền xem tài liệu này lần 3.
Tài khoản chưa có quyền tải tệp này mã 2.
Truy cập bị từ chối
Yêu cầu của bạn bị từ chối, mã lỗi 403
Phiên làm việc đã hết hạn. Vui lòng đăng nhập lại.
Phiên truy cập không còn hiệu lực. Mời đăng nhập lại và thử lần nữa.
Lượt đăng nhập bị ngắt. Xin đăng nhập lại để xem văn bản.
Hệ thống đang bảo trì, vui lòng thử lại sau 15 phút.
Hệ thống quá tải, mời quý khách trở lại sau.
Hệ thống tạm ngừng phục vụ, xin quay lại sau 20 phút.
Máy chủ đang bận, vui lòng thử lại sau.
Lỗi 500: lỗi máy chủ
Lỗi kết nối cơ sở dữ liệu
Mất kết nối cơ sở dữ liệu
Truy vấn quá thời gian cho phép
Không mở được bảng dữ liệu
Lỗi tải trang, vui lòng tải lại
Lỗi mở tệp: tệp rỗng mã 3
Lỗi chuyển đổi: thiếu phông chữ
Vui lòng bật JavaScript để xem nội dung trang.
Hãy kích hoạt JavaScript rồi tải lại trang.
Xin mở JavaScript trước khi tra cứu.
Cần phải cho phép script thì trang mới hiển thị được.
Tập lệnh đang bị chặn. Một số chức năng sẽ không hoạt động.
JavaScript chưa được bật. Một số chức năng tra cứu sẽ không hoạt động.
Trình duyệt của bạn không hỗ trợ tập lệnh, hãy nâng cấp để tiếp tục.
Trình duyệt này không chạy được script, đổi trình duyệt để tiếp tục.
"""

# Labelled rows for the classifier, filler.
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Lorem ipsum
Dolor sit amet magna aliqua
Tempor labore magna elit
Your text here
Placeholder text goes here.
Sample content number 3
Dummy paragraph. Replace before release.
Example heading. Do not publish.
This section is under construction
Coming soon
Content to be added
TODO: viết lại đoạn này
TODO: write this section
TBD
TBC
FIXME: kiểm tra lại
Nội dung đang được cập nhật
Phần này sẽ bổ sung sau.
Mục này chưa có dữ liệu
Chuyên mục đang chờ biên tập
Bài viết đang được biên tập
Đoạn này sẽ viết sau khi họp xong
Trang này chưa có nội dung
Tiêu đề bài viết ở đây
Tên chuyên mục ở đây
Tiêu đề số 1
Phụ đề bài viết số 3
Mô tả ngắn ở đây
Đoạn văn bản mẫu, hãy thay bằng nội dung thật.
Chữ giả để thử trình bày
Nội dung mẫu
Chèn hình số 2 vào chỗ trống
Dán biểu đồ vào khung này
Đặt hình và chú thích vào đây
test test 123
thử thử 12
test bài viết
kiểm tra đăng bài
thử nghiệm bài viết
abc abc xyz
aaa bbb ccc ddd
xxx xxx
asdf asdf
asdf qwer zxcv
hjkl jkl uiop
qwertyuiop
foo bar baz
??? ??? ???
... ... ...
"""

# Labelled rows for the classifier, what frames a page or heads a document.
FURNITURE = """
Trang chủ | Giới thiệu | Tra cứu | Liên hệ
Trang chủ » Văn bản » Thông tư
Home » Library » Circulars
Home | About | Contact
Đăng nhập Đăng ký Trợ giúp
© Cổng thông tin điện tử
© 2020 Ngân hàng Nhà nước
© Công báo
Copyright 2020. All rights reserved.
Bản quyền thuộc về cơ quan chủ quản
Menu Tìm kiếm
Mã theo dõi 12
ref 1234
node-7
edge 3
"""
